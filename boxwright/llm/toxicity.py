"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of a lexicon's terms by strength, terms near a second-person word, capitals, punctuation,
and rates of obfuscation (digits and signs inside words). The lexicon (whole words and word beginnings) is learnt from labelled
training texts: term counts by class are summed over executors, and all terms that tell the classes apart reach the driver,
whose number the sampled toxic texts bound. For a training text's own features the lexicon leaves out its fold, so that trees
see terms as they will on new texts.

Training uses at most ``SAMPLE`` labelled training rows (those of the smallest hash); a row trains unless crc32 of its id
modulo 4 is 2. Every text is scored whole. Null and empty texts are scored as texts without words. Repeated rows: one
result row each. Labels with nulls are left out; an id labelled more than once counts as toxic if any row says so. No labels or one class only: the constant share
is the score. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxwright.llm import bytesops
from boxwright.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees

SAMPLE, FOLDS, ROUNDS, THRESHOLD = 20_000, 3, 80, 0.3
#: Fixed list: second-person words of the four languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vuestro su sus".split()
#: Fixed pairs: signs that stand for letters inside words.
STANDS_FOR = dict(zip(b"013457@$!", b"oieastasi", strict=True))
PREFIXES, NEAR = (4, 5, 6), 4
#: Log-odds from which a term counts as weak, medium, strong.
TIERS = (1.5, 2.5, 4.0)
N_FEATURES = 2 * len(TIERS) * 2 + 12

_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_map = np.arange(256, dtype=np.uint8)
_map[list(STANDS_FOR)] = list(STANDS_FOR.values())
_sign = np.zeros(256, bool)
_sign[list(STANDS_FOR)] = True


class Runs(NamedTuple):
    words: bytesops.Words
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    replaced: np.ndarray


def letter_runs(w: bytesops.Words) -> Runs:
    """Runs of letters in lower case, with signs between two letters read as the letters they stand for."""
    buf = w.buf
    letter = _letter[buf]
    inner = np.zeros(len(buf), bool)
    if len(buf) > 2:
        inner[1:-1] = _sign[buf[1:-1]] & letter[:-2] & letter[2:]
        # a text's first and last byte have no letter on one side
        edge = w.offsets[1:-1]
        inner[edge[edge > 0] - 1] = False
        inner[edge[edge < len(buf)]] = False
    low = bytesops.lower_ascii(np.where(inner, _map[buf], buf))
    # Latin-1 capitals too
    lead = np.flatnonzero(buf[:-1] == 0xC3)
    upper = lead[(buf[lead + 1] >= 0x80) & (buf[lead + 1] <= 0x9E) & (buf[lead + 1] != 0x97)] + 1
    low[upper] += 0x20
    solid = letter | inner
    spaced = np.where(solid, np.uint8(97), np.uint8(32))
    runs = bytesops.split_words(spaced, w.offsets)
    return Runs(w, low, runs.starts, runs.ends, bytesops.doc_of(runs.first, len(runs.starts)), np.flatnonzero(inner))


def terms(r: Runs) -> list[tuple[np.ndarray, np.ndarray]]:
    """(runs, hash) of whole runs and of longer runs' beginnings, which have hashes of their own."""
    size = r.ends - r.starts
    every = np.arange(len(size))
    out = [(every, bytesops.span_hashes(r.low, r.starts, r.ends))]
    for k, n in enumerate(PREFIXES):
        own = every[size > n]
        out.append((own, bytesops.mix(bytesops.span_hashes(r.low, r.starts[own], r.starts[own] + n) + np.uint64(k + 1))))
    return out


class Lexicon(NamedTuple):
    """Sorted hashes and their log-odds."""

    hashes: np.ndarray
    odds: np.ndarray

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.odds[at], 0.0)


_second = np.sort(bytesops.hash_words(SECOND_PERSON))


def features(w: bytesops.Words, lexicon: Lexicon) -> np.ndarray:
    """One row of ``N_FEATURES`` numbers for each document of the group."""
    n, r = len(w.first) - 1, letter_runs(w)
    doc = r.doc
    size = np.maximum(np.diff(w.offsets), 1)
    words = np.bincount(doc, minlength=n)
    per = np.maximum(words, 1)
    found = terms(r)
    whole = lexicon.look_up(found[0][1])
    begins = np.zeros(len(doc))
    for own, hashes in found[1:]:
        begins[own] = np.maximum(begins[own], lexicon.look_up(hashes))
    columns = []
    for odds in (whole, begins):
        for tier in TIERS:
            hits = np.bincount(doc[odds >= tier], minlength=n)
            columns += [hits, hits / per]
    best = np.maximum(whole, begins)
    top = np.zeros(n)
    np.maximum.at(top, doc, best)
    columns += [top, np.bincount(doc, weights=best, minlength=n) / per]
    # terms with a second-person word of the same text near them
    second = np.isin(found[0][1], _second)
    seen = np.concatenate(([0], np.cumsum(second)))
    hit = np.flatnonzero(best >= TIERS[1])
    first = np.searchsorted(doc, np.arange(n + 1))
    near = seen[np.minimum(hit + NEAR + 1, first[doc[hit] + 1])] > seen[np.maximum(hit - NEAR, first[doc[hit]])]
    columns.append(np.bincount(doc[hit[near]], minlength=n))
    columns.append(np.bincount(doc[second], minlength=n) / per)
    total = lambda marks: np.diff(np.concatenate(([0], np.cumsum(marks)))[w.offsets])
    capital = (w.buf >= 65) & (w.buf <= 90)
    columns.append(total(capital) / size)
    capitals = np.concatenate(([0], np.cumsum(capital)))
    shouted = (capitals[r.ends] - capitals[r.starts] >= 0.8 * (r.ends - r.starts)) & (r.ends - r.starts >= 3)
    columns.append(np.bincount(doc[shouted], minlength=n) / per)
    columns.append(total((w.buf == 33) | (w.buf == 63)) / size)
    columns.append(total(((w.buf > 32) & (w.buf < 48)) | ((w.buf > 57) & (w.buf < 65))) / size)
    columns.append(total((w.buf >= 35) & (w.buf <= 38)) / size)
    columns.append(np.bincount(np.searchsorted(w.offsets, r.replaced, side="right") - 1, minlength=n)[:n] / per)
    columns.append(np.log1p(words))
    columns.append(size / per)
    out = np.stack([np.asarray(c, float) for c in columns], axis=1)
    assert out.shape[1] == N_FEATURES
    return out


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees
    calibration: Isotonic

    def scores(self, w: bytesops.Words) -> np.ndarray:
        return self.calibration(self.trees.logits(features(w, self.lexicon)))


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def remainder(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def fold_of(ids: np.ndarray) -> np.ndarray:
    return (bytesops.mix(ids.astype(np.int64).view(np.uint64) + np.uint64(99)) % np.uint64(FOLDS)).astype(np.int64)


def lexicon_from(counts: np.ndarray, hashes: np.ndarray, docs: np.ndarray, without: int | None = None) -> Lexicon:
    """``counts``: (term, fold, class); ``docs``: (fold, class). Log-odds of terms in at least 2 toxic texts."""
    folds = [f for f in range(FOLDS) if f != without]
    c, d = counts[:, folds].sum(axis=1), docs[folds].sum(axis=0)
    odds = np.log((c[:, 1] + 0.5) / (d[1] + 1)) - np.log((c[:, 0] + 0.5) / (d[0] + 1))
    # a term in few toxic texts needs to be missing from the others
    keep = (c[:, 1] >= 2) & (odds - 1.0 / np.sqrt(np.maximum(c[:, 1], 1)) >= TIERS[0])
    return Lexicon(hashes[keep], odds[keep])


def _telling(sizes: np.ndarray) -> Column:
    """Whether a term is in the lexicon of all folds or of all but one; a little wider than :func:`lexicon_from`, which decides."""
    out = F.lit(False)
    for without in (None, *range(FOLDS)):
        folds = [f for f in range(FOLDS) if f != without]
        clean, toxic = (sum((F.col(f"n{2 * f + k}") for f in folds), F.lit(0)) for k in (0, 1))
        d = sizes[folds].sum(axis=0)
        odds = F.log((toxic + 0.5) / float(d[1] + 1)) - F.log((clean + 0.5) / float(d[0] + 1))
        out = out | ((toxic >= 2) & (odds - 1 / F.sqrt(F.greatest(toxic, F.lit(1))) >= TIERS[0] - 1e-9))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(remainder() != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    ids, toxic = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    order = np.argsort(ids)
    ids, toxic = ids[order], (toxic[order] > 0).astype(np.int64)
    if not len(ids) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(ids) else 0.0
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), Trees(0.0, 1), Isotonic(np.zeros(1), np.full(1, share)))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, bytesops.Words]]:
        for b in batches:
            own = np.flatnonzero(np.isin(b.column(0).to_numpy(zero_copy_only=False), ids))
            if len(own):
                b = b.take(pa.array(own))
                for at, to, w in bytesops.words_in(b.column(1)):
                    yield b.column(0).slice(at, to - at).to_numpy(zero_copy_only=False), w

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_ids, w in sampled(batches):
            r = letter_runs(w)
            label = toxic[np.searchsorted(ids, own_ids)]
            group = fold_of(own_ids) * 2 + label
            for own, hashes in terms(r):
                # each term once a text
                key = np.unique(np.stack([hashes, r.doc[own].astype(np.uint64)]), axis=1) if len(own) else np.zeros((2, 0), np.uint64)
                if key.shape[1]:
                    n = np.zeros((key.shape[1], 2 * FOLDS), np.int64)
                    n[np.arange(key.shape[1]), group[key[1].astype(np.int64)]] = 1
                    yield pa.RecordBatch.from_arrays([pa.array(key[0].view(np.int64)), *(pa.array(c) for c in n.T)], names=["term", *(f"n{k}" for k in range(2 * FOLDS))])

    sums = [f"n{k}" for k in range(2 * FOLDS)]
    found = _input(docs).mapInArrow(count, "term long, " + ", ".join(f"{c} long" for c in sums)).groupBy("term").agg(*(F.sum(c).alias(c) for c in sums))
    folds = fold_of(ids)
    sizes = np.array([[np.sum((folds == f) & (toxic == k)) for k in (0, 1)] for f in range(FOLDS)], float)
    lines = found.where(_telling(sizes)).collect()
    hashes = np.array([r[0] for r in lines], np.int64).view(np.uint64)
    counts = np.array([r[1:] for r in lines], float).reshape(-1, FOLDS, 2)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    apart = [lexicon_from(counts, hashes, sizes, f) for f in range(FOLDS)]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own_ids, w in sampled(batches):
            fold, x = fold_of(own_ids), np.zeros((len(own_ids), N_FEATURES))
            for f in np.unique(fold):
                x[fold == f] = features(w, apart[f])[fold == f]
            yield pa.RecordBatch.from_arrays([pa.array(own_ids), pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), N_FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    got = _input(docs).mapInArrow(describe, "doc_id long, x array<double>").dropDuplicates(["doc_id"]).collect()
    got.sort(key=lambda r: r[0])
    own = np.array([r[0] for r in got], np.int64)
    x = np.array([r[1] for r in got], float).reshape(-1, N_FEATURES)
    y, fold = toxic[np.searchsorted(ids, own)].astype(float), fold_of(own)
    unseen = np.zeros(len(y))
    for f in range(FOLDS):
        if np.any(fold == f):
            unseen[fold == f] = fit_trees(x[fold != f], y[fold != f], ROUNDS).logits(x[fold == f])
    return Model(lexicon_from(counts, hashes, sizes), fit_trees(x, y, ROUNDS), fit_isotonic(unseen, y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.zeros(b.num_rows)
            for at, to, w in bytesops.words_in(b.column(1)):
                scores[at:to] = model.scores(w)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = _input(docs).withColumn("held_out", F.coalesce(remainder() == 2, F.lit(False)))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns as they are; decided in the scan, without a join."""
    model, names = train(docs, labels), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, to, w in bytesops.words_in(b.column(at).cast(pa.binary())):
                keep[lo:to] = model.scores(w) < THRESHOLD
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
