"""Near duplicates over content: a 64-bit similarity hash of whole texts, classes of equal hashes, links between classes.

Copies never meet each other: rows of one hash are a class with a representative (its smallest id), only representatives are compared,
and every row gets its class by one join. So k copies give k rows, whatever k is.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxwright.operators import graphs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word counts once more at each of these numbers of occurrences, so that frequent words do not drown the others.
STEPS = (1, 2, 4, 8, 16, 32, 64)
MOST = 4
#: A task remembers the hashes of so many words, and adds up so many at a time.
KNOWN, BLOCK = 1 << 18, 1 << 14


def _hash_of(text: bytes | None, known: dict[bytes, int]) -> int:
    """The hash of a text, as a signed long; ``known`` keeps words' hashes from text to text."""
    counts = Counter((text or b"").lower().split())  # of bytes: A-Z and ASCII white space alone
    if len(known) > KNOWN:
        known.clear()
    for w in counts:
        if w not in known:
            known[w] = int.from_bytes(md5(w, usedforsecurity=False).digest()[:8], "big")
    hashes = np.fromiter(map(known.__getitem__, counts), np.uint64, len(counts)).astype("<u8")
    weights = np.fromiter((bisect_right(STEPS, c) for c in counts.values()), np.uint8, len(counts))
    sums = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums += (bits * weights[at : at + BLOCK, None]).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > weights.sum(dtype=np.int64), bitorder="little").view("<i8")[0])


def fingerprints(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash) for every row: bit k is set if more than half the features' hashes (the first 64 bits of their MD5) have it. Texts without
    a word, null ones too, hash to zero. Rows of one key and text are one.

    A text is hashed where it is read; what is shuffled is a short row a text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for b in batches:
            hashes = pa.array([_hash_of(t.as_py(), known) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), hashes], names=["key", "version", "hash"])

    told = rows.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([T.StructField("key", told.schema["key"].dataType), T.StructField("version", T.LongType()), T.StructField("hash", T.LongType())])
    return told.mapInArrow(run, schema).dropDuplicates(["key", "version"]).select(F.col("key").alias(key), "hash")


def classes(prints: DataFrame, key: str = "doc_id") -> DataFrame:
    """(hash, representative, copies): one row for each distinct hash."""
    return prints.groupBy("hash").agg(F.min(key).alias("representative"), F.count("*").alias("copies"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def class_links(found: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b, distance), a < b: representatives whose hashes differ in 1 to ``most`` bits, each pair once.

    The hash is cut into ``most`` + 2 blocks, of which such hashes share two; rows meet on two blocks (some 21 bits for 4). A pair counts
    where these are the first two blocks that it shares, so no duplicates have to be removed.
    """
    n = most + 2
    edges = [64 * k // n for k in range(n + 1)]
    masks = [_signed(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = [F.struct(F.lit(1 << i | 1 << j).alias("own"), F.lit((1 << (j + 1)) - 1).alias("below"), F.col("hash").bitwiseAND(F.lit(masks[i] | masks[j])).alias("part")) for i, j in combinations(range(n), 2)]
    keyed = found.select(F.col("representative").alias("a"), F.col("hash").alias("hash_a"), F.explode(F.array(*keys)).alias("k")).select("a", "hash_a", "k.*")
    other = keyed.select(F.col("a").alias("b"), F.col("hash_a").alias("hash_b"), F.col("own").alias("own_b"), F.col("part").alias("part_b"))
    apart = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    shared = sum((F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k, m in enumerate(masks)), F.lit(0))
    first = shared.bitwiseAND(F.col("below")) == F.col("own")
    # rows on both sides grow with the input: neither is broadcast, however small the classes' files are
    met = keyed.join(other.hint("merge"), (F.col("own") == F.col("own_b")) & (F.col("part") == F.col("part_b")) & (F.col("a") < F.col("b")) & (F.bit_count(apart) <= most) & first)
    return met.select("a", "b", F.bit_count(apart).alias("distance"))


def membership(prints: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, representative) for every row."""
    return prints.join(found.select("hash", "representative"), "hash").select(key, "representative")


class NearDuplicates:
    """Fingerprints, classes and links of one table, each made once and kept in the shared folder."""

    def __init__(self, rows: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> None:
        self.key = key
        self.prints = graphs.materialise(fingerprints(rows, key, text), "prints")
        self.classes = graphs.materialise(classes(self.prints, key), "classes")
        self.links = graphs.materialise(class_links(self.classes, most), "links")

    def members(self) -> DataFrame:
        return membership(self.prints, self.classes, self.key)

    def both_ways(self) -> DataFrame:
        """(a, b): links in both directions, every class with itself too."""
        own = self.classes.select(F.col("representative").alias("a"), F.col("representative").alias("b"))
        return self.links.select("a", "b").union(self.links.select("b", "a")).union(own)

    def components(self) -> DataFrame:
        """(key, component, size) for every row: component is the smallest id that links reach, size its rows."""
        reached = graphs.connected_components(self.links.select("a", "b"))
        lone = F.coalesce("component", "representative").alias("component")
        placed = self.classes.join(reached.withColumnRenamed("node", "representative"), "representative", "left").select("hash", "copies", lone)
        sizes = placed.groupBy("component").agg(F.sum("copies").alias("size"))
        return self.prints.join(placed.join(sizes, "component").select("hash", "component", "size"), "hash").select(self.key, "component", "size")


#: DuckDB: table h (doc_id, hi, lo) with the same hash as two 32-bit halves.
HASH_SQL = rf"""w AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')) AS w FROM documents),
f AS (SELECT doc_id, md5(w) AS m, {" + ".join(f"CAST(count(*) >= {n} AS INT)" for n in STEPS)} AS weight FROM w GROUP BY doc_id, w),
v AS (SELECT doc_id, weight, CAST('0x' || m[1:8] AS BIGINT) AS hi, CAST('0x' || m[9:16] AS BIGINT) AS lo FROM f),
s AS (SELECT doc_id, k, sum(CASE WHEN (hi >> k) & 1 = 1 THEN weight ELSE -weight END) > 0 AS hi, sum(CASE WHEN (lo >> k) & 1 = 1 THEN weight ELSE -weight END) > 0 AS lo FROM v, (SELECT unnest(range(32)) AS k) GROUP BY doc_id, k),
h AS (SELECT d.doc_id, CAST(coalesce(sum(CASE WHEN s.hi THEN 1 << k END), 0) AS BIGINT) AS hi, CAST(coalesce(sum(CASE WHEN s.lo THEN 1 << k END), 0) AS BIGINT) AS lo FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
c AS (SELECT hi, lo, min(doc_id) AS representative, count(*) AS copies FROM h GROUP BY hi, lo),
m AS (SELECT doc_id, representative FROM h JOIN c ON c.hi = h.hi AND c.lo = h.lo),
near AS (SELECT a.representative AS a, b.representative AS b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM c a JOIN c b ON a.representative < b.representative AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {MOST}),
around AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near UNION ALL SELECT representative, representative FROM c)"""
#: DuckDB: table component (node, component) of all rows, after WITH RECURSIVE and ``HASH_SQL``.
COMPONENT_SQL = """reach AS (SELECT a AS node, a AS r FROM around UNION SELECT reach.node, e.b FROM reach JOIN around e ON e.a = reach.r),
least_of AS (SELECT node, min(r) AS component FROM reach GROUP BY node), component AS (SELECT doc_id AS node, component FROM m JOIN least_of l ON l.node = m.representative)"""
