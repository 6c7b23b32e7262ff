"""Names for intermediate columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def spare_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(df: DataFrame, taken: tuple[str, ...], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``operator`` gives for ``df``, whose columns of the names ``taken`` go by spare names meanwhile, so
    that the operator's own columns do not replace them."""
    moved = df
    for name in df.columns:
        if name.lower() in taken:
            moved = moved.withColumnRenamed(name, spare_name(moved, f"_own_{name}"))
    return operator(moved)


def restored(found: DataFrame, df: DataFrame, taken: tuple[str, ...]) -> DataFrame:
    """The columns of ``df`` from a result that ``beside`` gave."""
    names, moved = [], df
    for name in df.columns:
        names.append(name)
        if name.lower() in taken:
            names[-1] = spare_name(moved, f"_own_{name}")
            moved = moved.withColumnRenamed(name, names[-1])
    return found.select(*[found[a].alias(b) for a, b in zip(names, df.columns)])
