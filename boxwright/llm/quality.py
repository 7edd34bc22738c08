"""Quality rules: counts of repetition and markup, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted: one of the raw corpus (every document) and one of a trusted target
(documents labelled good; a bounded sample of labels, ``TRUSTED`` ids at most, those of the smallest hash). N-grams are
words, and three-byte runs in a range of buckets of their own. A document's score is the sum of its n-grams' log ratios
divided by their number plus ``PRIOR``; every document is held against the same threshold.

Null and empty texts have no words: counts 0, score 0, base_failed. Repeated rows: one result row each. Extra columns are
ignored. No trusted document: ratios are 0 and the base rules decide. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import bytesops

WINDOW, MIN_WORDS, MOST_REPEATED = 8, 20, 30
#: Buckets of each kind of n-gram, most labels taken for the target, n-grams a score is drawn to 0 by, least score kept.
BUCKETS, TRUSTED, PRIOR, LEAST_SCORE = 1 << 14, 20_000, 100, -0.4
#: Of a bucket's expected target count, so much is taken as seen: buckets too rare to tell have a ratio near 1.
SMOOTH = 10.0

_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True


def ngrams(w: bytesops.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(document, bucket) of the words and of the three-byte runs."""
    words = bytesops.span_hashes(w.buf, w.starts, w.ends) >> np.uint64(50)
    b = w.buf.astype(np.int64)
    runs = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * 0x9E3779B1 & 0xFFFFFFFF) >> 18
    own = np.repeat(np.arange(len(w.first) - 1), np.diff(w.offsets))
    inside = own[:-2] == own[2:]
    return [(bytesops.doc_of(w.first, len(w.starts)), words.astype(np.int64)), (own[:-2][inside], runs[inside] + BUCKETS)]


def ratios(docs: DataFrame, trusted: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket; ``trusted``: sorted doc_ids. The driver gets one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
        for batch in batches:
            good = np.isin(batch.column(0).to_numpy(zero_copy_only=False), trusted)
            for at, to, w in bytesops.words_in(batch.column(1)):
                for doc, bucket in ngrams(w):
                    raw += np.bincount(bucket, minlength=2 * BUCKETS)
                    target += np.bincount(bucket[good[at:to][doc]], minlength=2 * BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    rows = _input(docs).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    sums = np.zeros((2 * BUCKETS, 2))
    for bucket, raw, target in rows:
        sums[bucket] = raw, target
    raw, target = sums.reshape(2, BUCKETS, 2).transpose(2, 0, 1)
    expected = raw * target.sum(axis=1, keepdims=True) / np.maximum(raw.sum(axis=1, keepdims=True), 1)
    return np.log((target + SMOOTH) / (expected + SMOOTH)).reshape(-1) if len(trusted) else np.zeros(2 * BUCKETS)


def repeated_words(w: bytesops.Words, hashes: np.ndarray) -> np.ndarray:
    """Words of each document in windows of ``WINDOW`` words that the document has twice or more."""
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(len(w.first) - 1, np.int64)
    doc = bytesops.doc_of(w.first, n)
    window = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        window = window * np.uint64(0xD1B54A32D192ED03) + hashes[k : n - WINDOW + 1 + k]
    own = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    key = bytesops.mix(window[own] + bytesops.mix(doc[own].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    same = np.flatnonzero(key[order][1:] == key[order][:-1])
    twice = own[order[np.union1d(same, same + 1)]]
    cover = np.zeros(n + 1, np.int64)
    cover[twice] += 1
    cover[twice + WINDOW] -= 1
    return np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=len(w.first) - 1)


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The counts, verdicts and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column(1)
            for at, to, w in bytesops.words_in(texts):
                n = to - at
                doc = bytesops.doc_of(w.first, len(w.starts))
                n_words = np.diff(w.first)
                points = np.concatenate(([0], np.cumsum(bytesops.code_points(w.buf))))
                word_chars = np.bincount(doc, weights=points[w.ends] - points[w.starts], minlength=n).astype(np.int64)
                marks = np.concatenate(([0], np.cumsum(_symbol[w.buf])))[w.offsets]
                repeated = repeated_words(w, bytesops.span_hashes(w.buf, w.starts, w.ends))
                total, count = np.zeros(n), np.zeros(n)
                for own, bucket in ngrams(w):
                    total += np.bincount(own, weights=ratio[bucket], minlength=n)
                    count += np.bincount(own, minlength=n)
                value = total / (count + PRIOR)
                lines = np.array([duplicate_lines(t or b"") for t in texts.slice(at, n).to_pylist()], np.int64)
                failed = (n_words < MIN_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
                out.append((n_words, word_chars, np.diff(marks), lines, repeated, failed, ~failed & (value >= LEAST_SCORE), value))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(c)) for c in zip(*out, strict=True))], names=[c.split()[0] for c in SCORED.split(", ")])

    return _input(docs).mapInArrow(run, SCORED)


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> np.ndarray:
    """doc_ids labelled good: all, or the ``most`` of the smallest hash."""
    rows = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.unique(np.array([r[0] for r in rows], np.int64))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, ratios(docs, trusted_ids(labels)))
