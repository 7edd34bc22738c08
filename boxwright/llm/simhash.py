"""SimHash near-duplicate documents, linked through deletion-variant signatures.

A document's fingerprint has a bit set where over half of its 4-word shingles' XXH64 (seed 42) have it. Two
fingerprints that differ in at most 4 bits differ in at most one bit of some of 3 segments, so a key for each segment
and each wildcard bit in it (64 keys a fingerprint) is equal for every such pair. Equal keys are joined and verified.

Only distinct fingerprints take part, and a group of close ones is never expanded into all pairs: first each member of
a bucket is held against the bucket's smallest and largest member; after these links are contracted, only buckets that
still hold several components are joined, and there the members outside the bucket's largest component against all.
Every link between different components is tested, so components equal those of all pairs. Ends and largest components of
buckets are counted before the shuffle, and a bucket's outside members meet the others in blocks of ``BLOCK``, so no bucket
is bound to one task.

Null, empty and blank texts: fingerprint zero, linked like any other. Repeated rows: one row each. Extra columns are
ignored. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import bytesops
from boxwright.llm.graph import connected
from boxwright.llm.store import Tables, shuffled

WORDS, BITS, SEED = 4, 4, 42
#: So many members of a bucket meet the others in one task.
BLOCK = 4096
#: (first bit, bits) of the segments; 4 differing bits leave one with at most one.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprints_of(column: pa.Array) -> np.ndarray:
    """The fingerprint of each text of a binary column, as unsigned 64-bit numbers."""
    out = np.zeros(len(column), np.uint64)
    for at, to, w in bytesops.words_in(column, lower=True):
        if len(w.starts):
            out[at:to] = _fingerprints(w)
    return out


def _fingerprints(w: bytesops.Words) -> np.ndarray:
    size = w.ends - w.starts
    doc = bytesops.doc_of(w.first, len(w.starts))
    # the words again, one space before each but a document's first
    gap = np.ones(len(size), np.int64)
    gap[w.first[:-1][np.diff(w.first) > 0]] = 0
    new_ends = np.cumsum(size + gap)
    new_starts = new_ends - size
    joined = np.full(new_ends[-1], 32, np.uint8)
    solid = np.zeros(len(w.buf) + 1, np.int64)
    np.add.at(solid, w.starts, 1)
    np.add.at(solid, w.ends, -1)
    into = np.zeros(len(joined) + 1, np.int64)
    np.add.at(into, new_starts, 1)
    np.add.at(into, new_ends, -1)
    joined[np.cumsum(into)[:-1] > 0] = w.buf[np.cumsum(solid)[:-1] > 0]
    # a shingle ends 3 words on; shorter documents have one
    count = np.diff(w.first)
    last = np.minimum(np.arange(len(size)) + WORDS - 1, w.first[1:][doc] - 1)
    number = np.arange(len(size)) - w.first[:-1][doc]
    kept = number < np.maximum(count[doc] - WORDS + 1, 1)
    view, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[s:e], SEED) for s, e in zip(new_starts[kept].tolist(), new_ends[last[kept]].tolist(), strict=True)), np.uint64, int(kept.sum()))
    per = np.maximum(count - WORDS + 1, 1) * (count > 0)
    return _majority(hashes, per)


def _majority(hashes: np.ndarray, per: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """Bits set in over half of each document's hashes; ``per`` has how many each has."""
    doc = np.repeat(np.arange(len(per)), per)
    sums = np.zeros((len(per), 64), np.int64)
    for at in range(0, len(hashes), block):
        part, own = hashes[at : at + block], doc[at : at + block]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        np.add.at(sums, own[begin], np.add.reduceat(bits, begin, axis=0, dtype=np.int32))
    return np.packbits(2 * sums > per[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints_of(b.column(1)).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _keys(fp) -> list:
    """One key for each wildcard bit: the bit's number above, the segment without the bit below."""
    out = []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        out += [segment.bitwiseAND(F.lit(~(1 << j))).bitwiseOR(F.lit((first + j) << 22)) for j in range(bits)]
    return out


def _keyed(fps: DataFrame, *more: str) -> DataFrame:
    return shuffled(fps.select("fp", *more, F.explode(F.array(*_keys(F.col("fp")))).alias("key")))


def _close(a: str, b: str) -> str:
    return f"bit_count({a} ^ {b}) <= {BITS}"


def near_components(distinct: DataFrame, tables: Tables, name: str = "simhash") -> DataFrame:
    """``distinct``: (fp), each once. Returns (fp, root) for fingerprints with a link: the smallest one reachable."""
    # ends are counted before the shuffle; a hot bucket's members then meet one row in a plain join, which may be split
    ends = _keyed(distinct).groupBy("key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    near = _keyed(distinct).join(ends, "key").where(f"(fp <> low AND {_close('fp', 'low')}) OR (fp <> high AND {_close('fp', 'high')})")
    near = tables.cut(near.select("fp", "low", "high"), f"{name}-near")
    star = near.where(_close("fp", "low")).select("fp", "low").union(near.where(_close("fp", "high")).select("fp", "high"))
    first = tables.keep(*connected(star.toDF("a", "b"), f"{name}-star"))
    tables.drop(near)
    # what is still apart within a bucket; of two members the link is tested already
    parts = shuffled(distinct.select("fp")).join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"))
    parts = tables.cut(parts, f"{name}-parts")
    shares = _keyed(parts, "part").groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = shares.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "part")).alias("main"), F.count("*").alias("parts")).where("n > 2 AND parts > 1")
    # the members outside the largest part in blocks, each of which meets the whole bucket
    blocks = F.ceil((F.col("n") - F.col("main.n")) / BLOCK).cast("int")
    mixed = _keyed(parts, "part").join(mixed.select("key", F.col("main.part").alias("main"), blocks.alias("blocks")), "key")
    mixed = tables.cut(mixed, f"{name}-mixed")
    left = mixed.where("part <> main").select("key", F.pmod(F.xxhash64("fp"), "blocks").cast("int").alias("block"), F.col("fp").alias("fp_a"), F.col("part").alias("a"))
    right = mixed.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("fp").alias("fp_b"), F.col("part").alias("b"))
    met = (left["key"] == right["key"]) & (left["block"] == right["block"]) & F.expr("a <> b") & F.expr(_close("fp_a", "fp_b"))
    cross = shuffled(left).join(right, met).select("a", "b").distinct()
    second = tables.keep(*connected(cross, f"{name}-cross"))
    tables.drop(parts, mixed)
    second = second.withColumnRenamed("node", "part").withColumnRenamed("component", "whole")
    nodes = first.withColumnRenamed("node", "fp").withColumnRenamed("component", "part")
    alone = second.join(nodes, second["part"] == nodes["fp"], "left_anti").select(F.col("part").alias("fp"), F.col("whole").alias("root"))
    return nodes.join(second, "part", "left").select("fp", F.coalesce("whole", "part").alias("root")).union(alone)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) for every row; component_id is the smallest doc_id of its component."""
    tables = Tables()
    prints = tables.cut(fingerprints(docs), "simhash-prints")
    by_print = tables.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "simhash-distinct")
    roots = near_components(by_print.select("fp"), tables)
    rooted = shuffled(by_print).join(roots, "fp", "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    rooted = tables.cut(rooted, "simhash-rooted")
    tables.drop_all_but(prints, rooted)
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_print = shuffled(rooted).join(least, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return shuffled(prints).join(of_print, "fp").select("doc_id", hexed, "component_id", "fp")


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows whose doc_id is the smallest of its component; all columns stay."""
    found = near_duplicates(docs).where("doc_id <> component_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(found, docs["doc_id"] == found["_dropped"], "left_anti")
