"""Secret scanning through an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. A ledger in a shared folder has a row for each blob that a rule
version has scanned; a run scans only blobs without such a row, appends theirs, and joins the findings back to every
path (here: document) that holds the blob. Copies are combined before the shuffle, so a blob that a third of all rows
share is moved once a task and scanned once.

Null and empty texts are the empty blob, without findings. Repeated rows: one result row each. Ties: spans are ordered by
start, then by kind in the order of ``KINDS``. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm.store import fresh_path

#: A new version makes every blob unseen again.
RULES_VERSION = "2"
BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}
#: What the method adds: private key blocks, tokens of code hosts and chat services, signed web tokens, passwords in URLs.
MORE = {
    "pem": (b"-----BEGIN", re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z0-9 ]*PRIVATE KEY-----")),
    "host_token": (b"_", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{30,}|glpat-[A-Za-z0-9_-]{20,})")),
    "chat_token": (b"xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    "web_token": (b"eyJ", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "url_password": (b"://", re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]{3,}@")),
}
KINDS = [*BASE, *MORE]
_hex = np.zeros(256, bool)
_hex[list(b"0123456789abcdef")] = True
FOUND = "sha binary, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_EMPTY = hashlib.sha256(b"").hexdigest()


def has_long_hex(raw: bytes) -> bool:
    """Whether 16 hexadecimal digits stand in a row."""
    run = _hex[np.frombuffer(raw, np.uint8)]
    for step in (1, 2, 4, 8):
        if len(run) <= step:
            return False
        run = run[:-step] & run[step:]
    return bool(run.any())


def base_spans(raw: bytes, text: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points of the base kinds, by start, then kind."""
    look = {"assign": b"=" in raw or b":" in raw, "access": b"AKIA" in raw, "hex": has_long_hex(raw)}
    if not any(look.values()):
        return []
    text = raw.decode("utf-8", "replace") if text is None else text
    out = []
    if look["assign"]:
        out += [(m.start(), m.end(), "assign") for m in BASE["assign"].finditer(text) if len(m[2]) >= 12]
    if look["access"]:
        out += [(m.start(), m.end(), "access") for m in BASE["access"].finditer(text) if len(m[0]) >= 18]
    if look["hex"]:
        out += [(m.start(), m.end(), "hex") for m in BASE["hex"].finditer(text) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def all_spans(raw: bytes, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The base spans and those of the other kinds."""
    kinds = [k for k, (mark, _) in MORE.items() if mark in raw]
    if not kinds:
        return base
    text = raw.decode("utf-8", "replace")
    out = base + [(m.start(), m.end(), k) for k in kinds for m in MORE[k][1].finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze.compress(t) for t in b.column(1).to_pylist()], pa.binary())], names=["sha", "blob"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for blob in b.column(1).to_pylist():
            raw = expand.decompress(blob)
            base = base_spans(raw)
            counts = [sum(s[2] == k for s in base) for k in BASE]
            rows.append((*counts, hashlib.sha256(_join(base).encode()).hexdigest() if base else _EMPTY, _join(all_spans(raw, base))))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()] * 2, strict=True))], names=["sha", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(versions: DataFrame, path_columns: list[str], ledger: str | None = None) -> DataFrame:
    """``versions``: path columns and text. Returns the path columns, n_assign, n_access, n_hex, base_sha256, spans for
    every row. ``ledger``: folder of the ledger; a fresh one if not given. Appends what this run had to scan."""
    spark = versions.sparkSession
    ledger = ledger or fresh_path(spark, "secret-ledger")
    addressed = versions.select(*path_columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))
    blobs = addressed.select("sha", "text").mapInArrow(_pack, "sha binary, blob binary").dropDuplicates(["sha"])
    table = f"{ledger}/rules={RULES_VERSION}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(table)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        seen = spark.read.schema(FOUND).parquet(table).select("sha")
        blobs = blobs.join(seen, "sha", "left_anti")
    blobs.mapInArrow(_scan, FOUND).write.mode("append").parquet(table)
    found = spark.read.schema(FOUND).parquet(table).where("spans <> ''").dropDuplicates(["sha"])
    return addressed.select(*path_columns, "sha").join(found, "sha", "left").select(
        *path_columns, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_assign", "n_access", "n_hex")), F.coalesce("base_sha256", F.lit(_EMPTY)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )
