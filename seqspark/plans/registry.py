"""All registered queries of the sequence engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a query ``(spark, sf_dir) -> DataFrame`` under a name, with its SQL twin if it has one."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE[name] = oracle
        return f

    return put


from . import assembly, chemistry, files, sites  # noqa: E402, F401  registers
