"""Merkle manifest of a table, with a version of the tree for every tampered row.

Rows are leaves; per source they stand in the order of ids, and every three consecutive nodes become their
hash until one is left, the subroot. The subroots, in the order of sources, become the root likewise.

The tree is cut in aligned blocks of ``3 ** height`` nodes, and the roots of blocks are the nodes of the next,
smaller table. Within a block a tree is persistent: a tampered leaf makes a version that copies the ancestors
of the leaf and shares all other nodes. What lies above a block is written as one path for each block, so
versions are continued there, block by block, wherever their rows are; no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqspark.session import materialize

from .language import crc_of

FAN = 3
#: Levels of a block, which so has 729 nodes at most.
HEIGHT = 6
#: Stands for the node itself in a run of siblings.
OWN = "*"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


class Tree:
    """A block: its nodes level by level. Versions copy what changes and never touch the block."""

    def __init__(self, leaves: list[str], levels: int | None):
        """``levels`` above the leaves; None is as many as leave one node."""
        self.levels = [leaves]
        while len(self.levels[-1]) > 1 if levels is None else len(self.levels) <= levels:
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, place: int) -> list[str]:
        """The runs above a leaf, level by level, with ``*`` for what leads to the leaf."""
        out = []
        for nodes in self.levels[:-1]:
            start = place - place % FAN
            out.append("".join(OWN if i == place else nodes[i] for i in range(start, min(start + FAN, len(nodes)))))
            place //= FAN
        return out

    def version(self, place: int, leaf: str) -> list[str]:
        """The copied nodes of the version in which one leaf differs, from the leaf to the root."""
        return copied_nodes(leaf, self.path(place))


def copied_nodes(node: str, path: list[str]) -> list[str]:
    """A node and its new ancestors along a path; all siblings are shared."""
    out = [node]
    for run in path:
        out.append(digest(run.replace(OWN, out[-1])))
    return out


def _field(column: str) -> Column:
    value = F.col(column).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """``(source, doc_id, leaf, tampered)``: the digest of each row, and without the line breaks of its text
    where the row is tampered with, else null."""
    kept = docs.select("doc_id", "source", "lang", "n_chars", "text")
    head = [_field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = (F.pmod(crc_of("doc_id"), F.lit(2)) == 0) & F.contains(F.col("text"), F.lit("\n"))
    flat = F.replace(F.col("text"), F.lit("\n"), F.lit(""))
    flat_text = F.concat(F.octet_length(flat).cast("string"), F.lit(":"), flat)
    return kept.select(
        F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.sha2(F.concat(*head, _field("text")), 256).alias("leaf"),
        F.when(changed, F.sha2(F.concat(*head, flat_text), 256)).alias("tampered"),
    )


def placed(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with ``place``, from 0 in its group, and ``total``, the rows of the group; written once.

    ``order`` must tell all rows apart. Rows are sorted by ranges, so that a group of any size lies in as
    many tasks as it needs; what is counted is a row for each range and group in it.
    """
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = nodes.repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    mark = F.monotonically_increasing_id()
    dealt = materialize(dealt.withColumn("_at", mark).withColumn("_part", F.spark_partition_id()), "sorted")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy(group)
    before = F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_own_part"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("total")
    )
    same = (F.col("_part") == F.col("_own_part")) & F.col(group).eqNullSafe(F.col("_group"))
    found = dealt.join(counts, same).withColumn("place", F.col("_at") + F.col("_shift"))
    return materialize(found.drop("_at", "_part", "_own_part", "_group", "_shift"), "placed")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows dealt by block and in the order of places; the row of a path has place -1 in its block."""
    block = F.coalesce("block", F.floor(F.col("place") / size))
    return rows.withColumn("block", block).repartition("source", "block").sortWithinPartitions("source", "block", "place")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each whole block."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (row["source"], row["block"]) != (held[-1]["source"], held[-1]["block"]):
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _tree(rows: list[dict], column: str, height: int) -> Tree:
    whole = rows[0]["total"] <= FAN**height
    return Tree([r[column] for r in rows], None if whole else height)


def _block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """``(source, place, total, node)`` of the next table of nodes."""
    size = FAN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_block(batches):
            one = {"source": rows[0]["source"], "place": rows[0]["block"], "total": -(-rows[0]["total"] // size), "node": _tree(rows, "node", height).root}
            yield pa.RecordBatch.from_pylist([one], _schema(NODE))

    dealt = _blocks(nodes.select("source", "place", "total", "node", F.lit(None).cast("long").alias("block")), size)
    return materialize(dealt.mapInArrow(run, NODE), "nodes")


NODE = "source string, place long, total long, node string"
PATH = "source string, block long, path array<string>, subroot string"
LEAF = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"
KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, KINDS[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def _levels(nodes: DataFrame, height: int) -> list[DataFrame]:
    """``nodes`` and the tables of block roots above it; the last one has one node for each source."""
    levels = [nodes, _block_roots(nodes, height)]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > 1:
        levels.append(_block_roots(levels[-1].where("total > 1"), height))
    return levels


def _tops(levels: list[DataFrame]) -> DataFrame:
    """The one node of each source, from the level where it is alone."""
    out = levels[1].where("total = 1")
    for level in levels[2:]:
        out = out.union(level.where("total = 1"))
    return out


def _with_paths(nodes: DataFrame, paths: DataFrame, names: list[str], height: int) -> DataFrame:
    """Rows of nodes and, as the first row of each block, the path of its root."""
    own = nodes.select("source", "place", "total", *names, F.lit(None).cast("long").alias("block"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"))
    nulls = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in names]
    heads = paths.select("source", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("total"), *nulls, "block", "path", "subroot")
    return _blocks(own.union(heads), FAN**height)


def _node_paths(nodes: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """Paths of the nodes of a table, each of which is the root of a block below, from those of its blocks.

    A path without nodes is that of a source whose top lies further down, and stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _each_block(batches):
            if not rows:
                yield pa.RecordBatch.from_pylist([{c: head[c] for c in ("source", "block", "path", "subroot")}], _schema(PATH))
                continue
            tree = _tree(rows, "node", height)
            found = [{"source": r["source"], "block": r["place"], "path": tree.path(i) + head["path"], "subroot": head["subroot"]} for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(found, _schema(PATH))

    return materialize(_with_paths(nodes, paths, ["node"], height).mapInArrow(run, PATH), "paths")


def _down(levels: list[DataFrame], paths: DataFrame, height: int) -> DataFrame:
    """Paths of the blocks of the lowest table, from those of the one node of each source."""
    for level in reversed(levels[1:-1]):
        paths = _node_paths(level.where("total > 1"), paths, height)
    return paths


def merkle_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every row of documents.

    A leaf is the digest of doc_id, source, lang, n_chars and text, nulls included. Per source (a null source
    is one of its own, the first) leaves ascend by doc_id, null first; rows of one id by their leaf, so that
    only equal rows are told apart by how they were read, which changes no root. ``proof_sha256`` is the
    digest of the siblings from the leaf to the root. ``folded_root`` is the root of the version with the
    tampered leaf, where the crc32 of the id is even (a null id is never tampered with), else of the leaf;
    ``verified`` is whether it is the root. A lone leaf is the subroot, and a lone subroot the root. An empty
    table gives no row. Texts are digested where they are read, whatever their length, and never shuffled;
    extra columns are not read.
    """
    leaves = leaf_digests(docs).withColumn("_row", F.monotonically_increasing_id())
    leaves = materialize(leaves, "leaves")
    ordered = placed(leaves, "source", ["doc_id", "leaf", "_row"]).drop("_row").withColumnRenamed("leaf", "node")
    levels = _levels(ordered, height)
    tops = _tops(levels)
    # the tree over sources is one more of the same kind, of one group
    subroots = placed(tops.select(F.lit("").alias("all"), F.col("source").alias("name"), "node"), "all", ["name"]).withColumnRenamed("all", "source")
    upper = _levels(subroots, height)
    top = upper[-1].first()  # one row
    root = F.lit(top["node"] if top else None).cast("string")
    start = upper[-1].select("source", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"), F.col("node").alias("subroot"))
    above = _down(upper, start, height)
    named = subroots.select(F.lit("").alias("source"), "place", "total", "node", "name")
    paths = _down(levels, _source_paths(named, above, height), height)
    found = _leaf_rows(ordered, paths, height)
    return found.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def _source_paths(subroots: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """The path of each subroot, named by its source, as that of the one block at the top of the source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _each_block(batches):
            tree = _tree(rows, "node", height)
            found = [{"source": r["name"], "block": 0, "path": tree.path(i) + head["path"], "subroot": r["node"]} for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_pylist(found, _schema(PATH))

    return materialize(_with_paths(subroots, paths, ["node", "name"], height).mapInArrow(run, PATH), "paths")


def _leaf_rows(leaves: DataFrame, paths: DataFrame, height: int) -> DataFrame:
    """The result for each leaf: its version of the block, continued along the path of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in _each_block(batches):
            tree, above = _tree(rows, "node", height), head["path"]
            rest = "".join(above).replace(OWN, "")
            found = []
            for i, r in enumerate(rows):
                within = tree.version(i, r["tampered"] or r["node"])[-1]
                found.append(
                    {"doc_id": r["doc_id"], "leaf": r["node"], "subroot": head["subroot"], "proof_sha256": digest("".join(tree.path(i)).replace(OWN, "") + rest), "folded_root": copied_nodes(within, above)[-1]}
                )
            yield pa.RecordBatch.from_pylist(found, _schema(LEAF))

    return _with_paths(leaves, paths, ["doc_id", "node", "tampered"], height).mapInArrow(run, LEAF)
