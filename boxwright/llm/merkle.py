"""Merkle manifest of a dataset: an external node store, built level by level, and a proof for every record.

Records are leaves; the leaves of a source, by doc_id, form a tree of runs of three, and the sources' roots, by source, one more.
Leaves are sorted by ranges into runs, so that a source with a third of all rows is spread over tasks, and get their place from counts
by range. Nodes are rows (tree, level, pos, n, hash) of a Parquet store partitioned by level, ``n`` being the nodes of that tree on that
level. A sequential scan of one level, in runs of ``3**BAND`` consecutive nodes, gives the next ``BAND`` levels; a run is all that a
task holds. Proofs come down the same way: a merge scan over the levels of a band and the paths of the nodes above, sorted by
coordinate, gives the paths of the nodes below.

A path is binary: for each level from the leaf to the root a byte with the node's place in its run, one with the run's nodes, and the
others' digests.

Null fields are written as ``-`` into a leaf, null sources come first, null ids first within a source. Ties: rows of one source and
doc_id are ordered by leaf, and rows that are equal are leaves of their own. Empty and very long texts are hashed whole. Extra columns
are ignored. An empty table has no root and gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxwright.llm.store import Tables, fresh_path, small_batches

FAN = 3
#: Levels that one scan gives.
BAND = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODE = "tree string, pos long, n long, hash binary, doc_id long, name string, changed binary"
_PATHS = "tree string, pos long, hash binary, doc_id long, name string, changed binary, path binary, top binary"
_PROOFS = "source string, doc_id long, hash binary, changed binary, subroot binary, root binary, proof binary"
_CHECKED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


class Manifest(NamedTuple):
    """``root`` is None for an empty table; ``depths`` are the most levels above the leaves of a source, and of the sources."""

    path: str
    root: bytes | None
    depths: tuple[int, int]


def leaf_hash(fields: dict[str, Column]) -> Column:
    """The leaf of a record as 32 bytes."""

    def part(c: Column) -> Column:
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.unhex(F.sha2(F.concat(*(part(fields[f]) for f in FIELDS)), 256))


def node_hash(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join([h.hex().encode() for h in run])).digest()


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves."""
    return sum(((n > F.lit(FAN**k)).cast("int") for k in range(1, 40)), (n > F.lit(1)).cast("int"))


def _placed(rows: DataFrame, order: list[str], tables: Tables) -> tuple[DataFrame, int]:
    """``rows`` with their place ``pos`` in their tree by ``order`` and the tree's size ``n``; the largest size."""
    columns = [F.asc_nulls_first(c) for c in ["tree", *order]]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    runs = tables.cut(rows.repartitionByRange(*columns).sortWithinPartitions(*columns).select("*", F.spark_partition_id().alias("part"), at.alias("at")), "merkle-runs")
    own = Window.partitionBy("tree")
    shares = runs.groupBy("part", "tree").agg(F.count("*").alias("rows"), F.min("at").alias("first")).select(
        "part", "tree", "first", F.coalesce(F.sum("rows").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("rows").over(own).alias("n")
    )
    shares = tables.cut(shares, "merkle-shares")
    return runs.join(shares, ["part", "tree"]).withColumn("pos", F.col("at") - F.col("first") + F.col("before")), shares.agg(F.max("n")).first()[0] or 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, list[tuple]]]:
    """(tree, run, the rest of its rows) of batches sorted by tree and run, the first two columns."""
    key, held = None, []
    for tree, run, *rest in _rows(batches):
        if (tree, run) != key:
            if held:
                yield *key, held
            key, held = (tree, run), []
        held.append(rest)
    if held:
        yield *key, held


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted nodes (tree, run, pos, n, hash) of one level; all nodes above them within the band, ``level`` from 1."""
    for tree, run, rows in _groups(batches):
        nodes, n, out = [r[2] for r in rows], rows[0][1], []
        for k in range(1, BAND + 1):
            if n == 1:
                break
            nodes, n = [node_hash(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)], -(-n // FAN)
            first = run * FAN ** (BAND - k)
            out += [(tree, k, first + i, n, h) for i, h in enumerate(nodes)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary()], strict=True)], names=["tree", "up", "pos", "n", "hash"])


def _level(spark: SparkSession, store: str, level: int) -> DataFrame:
    return spark.read.schema(_NODE).parquet(f"{store}/level={level}")


def _run(levels_left: int) -> Column:
    return F.floor(F.col("pos") / F.lit(FAN**levels_left)).cast("long").alias("run")


def _grow_store(placed: DataFrame, most: int, store: str) -> int:
    """Writes a forest's leaves and all levels above them; returns the levels above the leaves of the largest tree."""
    spark = placed.sparkSession
    placed.select(*(c.split()[0] for c in _NODE.split(", "))).write.parquet(f"{store}/level=0")
    depth = 0
    while FAN**depth < most:
        depth += 1
    for base in range(0, depth, BAND):
        nodes = _level(spark, store, base).where("n > 1").select("tree", _run(BAND), "pos", "n", "hash")
        grown = nodes.repartition("tree", "run").sortWithinPartitions("tree", "run", "pos").mapInArrow(_grow, "tree string, up int, pos long, n long, hash binary")
        grown.select("tree", "pos", "n", "hash", (F.col("up") + base).alias("level")).write.mode("append").partitionBy("level").parquet(store)
    return depth


def _tops(spark: SparkSession, store: str) -> DataFrame:
    """The root of every tree of a forest: tree, hash, level."""
    return spark.read.schema("tree string, pos long, n long, hash binary, level int").parquet(store).where("n = 1").select("tree", "hash", "level")


def build(docs: DataFrame, path: str | None = None, altered: Column | None = None) -> Manifest:
    """Writes the node store of ``docs`` under ``path`` (a fresh shared folder if not given). ``altered``: another text, whose leaf is
    kept beside the record's own, to be checked against the record's proof; null where there is none."""
    spark, tables = small_batches(docs).sparkSession, Tables()
    path = path or fresh_path(spark, "merkle")
    fields = {f: F.col(f) for f in FIELDS}
    changed = F.lit(None).cast("binary") if altered is None else F.when(altered.isNotNull(), leaf_hash(fields | {"text": altered}))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    leaves = tables.cut(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(fields).alias("hash"), F.lit(None).cast("string").alias("name"), changed.alias("changed")), "merkle-leaves")
    placed, most = _placed(leaves, ["doc_id", "hash"], tables)
    inner = _grow_store(placed, most, f"{path}/records")
    tables.drop_all_but()
    sources = _tops(spark, f"{path}/records").select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed"))
    placed, most = _placed(sources, ["name"], tables)
    outer = _grow_store(placed, most, f"{path}/sources")
    tables.drop_all_but()
    root = _tops(spark, f"{path}/sources").first()
    return Manifest(path, bytes(root["hash"]) if root else None, (inner, outer))


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (tree, run, rank, pos, n, hash, doc_id, name, changed): rank 0 is the path of the node above (in ``hash``, its
    tree's root in ``changed``), the others are the band's levels from the lowest."""
    for tree, _, rows in _groups(batches):
        path, top = rows[0][3], rows[0][6]
        lowest, levels = [r for r in rows if r[0] == 1], {}
        for rank, _, n, h, *_ in rows[1:]:
            if n > 1:
                levels.setdefault(rank, []).append(h)
        above = [path]
        for rank in sorted(levels, reverse=True):
            nodes = levels[rank]
            runs = [nodes[i : i + FAN] for i in range(0, len(nodes), FAN)]
            above = [bytes((k, len(run))) + b"".join(run[:k]) + b"".join(run[k + 1 :]) + above[i] for i, run in enumerate(runs) for k in range(len(run))]
        columns = [[tree] * len(lowest), *([r[k] for r in lowest] for k in (1, 3, 4, 5, 6)), above, [top] * len(lowest)]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _PATHS.split(", ")])


def _paths(spark: SparkSession, store: str, depth: int, tops: DataFrame) -> DataFrame:
    """The path of every leaf of a forest. ``tops``: tree, level of its root, path and top for each root."""
    bands = range(depth // BAND * BAND, -1, -BAND)
    columns = ["tree", "run", "rank", "pos", "n", "hash", "doc_id", "name", "changed"]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("n", "long"))]
    more = [F.lit(None).cast(t).alias(c) for c, t in (("doc_id", "long"), ("name", "string"))]
    found = None
    for base in bands:
        here = tops.where(F.floor(F.col("level") / BAND) == base // BAND).select("tree", F.lit(0).cast("long").alias("run"), "path", "top")
        upper = here if found is None else here.union(found.select("tree", F.col("pos").alias("run"), "path", "top"))
        rows = upper.select("tree", "run", F.lit(0).alias("rank"), *none, F.col("path").alias("hash"), *more, F.col("top").alias("changed"))
        for k in range(min(BAND, depth - base + 1)):
            level = _level(spark, store, base + k)
            rows = rows.union((level if k == 0 else level.where("n > 1")).select("tree", _run(BAND - k), F.lit(k + 1).alias("rank"), *columns[3:]))
        found = rows.repartition("tree", "run").sortWithinPartitions("tree", "run", "rank", "pos").mapInArrow(_descend, _PATHS)
    return found


def proofs(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """A row for each record: source, doc_id, hash (its leaf), changed, subroot, root, proof."""
    if manifest.root is None:
        return spark.createDataFrame([], _PROOFS)
    root = F.lit(manifest.root)
    top = _tops(spark, f"{manifest.path}/sources").select("tree", "level", F.lit(b"").alias("path"), root.alias("top"))
    outer = _paths(spark, f"{manifest.path}/sources", manifest.depths[1], top).select(F.col("name").alias("tree"), "path", F.col("hash").alias("top"))
    tops = _tops(spark, f"{manifest.path}/records").select("tree", "level").join(outer, "tree")
    found = _paths(spark, f"{manifest.path}/records", manifest.depths[0], tops)
    source = F.when(F.col("tree") != "", F.substr("tree", F.lit(2))).alias("source")
    return found.select(source, "doc_id", "hash", "changed", F.col("top").alias("subroot"), root.alias("root"), F.col("path").alias("proof"))


def steps(proof: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """(place in the run, the others of the run) from leaf to root."""
    at = 0
    while at < len(proof):
        place, others = proof[at], proof[at + 1] - 1
        yield place, [proof[at + 2 + 32 * i : at + 34 + 32 * i] for i in range(others)]
        at += 2 + 32 * others


def fold(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and a proof give."""
    for place, others in steps(proof):
        leaf = node_hash([*others[:place], leaf, *others[place:]])
    return leaf


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _CHECKED.split(", ")]
    for b in batches:
        out = []
        for doc_id, leaf, changed, subroot, root, proof in _rows([b]):
            digest = hashlib.sha256(b"".join([h.hex().encode() for _, others in steps(proof) for h in others])).hexdigest()
            got = fold(leaf if changed is None else changed, proof)
            out.append((doc_id, leaf.hex(), subroot.hex(), root.hex(), digest, got.hex(), got == root))
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.string()] * 5, pa.bool_()], strict=True)], names=names)


def verified(found: DataFrame) -> DataFrame:
    """Folds every proof of :func:`proofs` from the changed leaf where there is one: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified."""
    return found.select("doc_id", "hash", "changed", "subroot", "root", "proof").mapInArrow(_check, _CHECKED)
