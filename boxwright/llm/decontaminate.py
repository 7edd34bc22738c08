"""Benchmark decontamination: CGK walks with sampled steps as keys, looked up at every word; exact edit verification.

CGK walks a string with a random bit for each (step, symbol): the walk emits the symbol it stands on and moves on where the bit is 1,
so edits become differing steps. Symbols here are words (hashes of their lower-case letters and digits), walks begin at every word of
an item and of a document, and two steps are sampled. What two steps at most ``GAPS`` moves apart can emit is a word and one of the ``GAPS``
next ones, so instead of repeating random walks until the recall is reached all their outcomes are keys: a passage is met wherever any
two words so near each other are left whole. Of a key one word at least is not common among the items, if its item has others.

A key that a document and an item share places an item-sized window in the text. Around the key, grams of the window must mostly stand where the item has them
(``ALIGNED``; at a similarity of 0.8 half of them do, by chance few), which numpy counts for all keys of a group at once; then
the item is held against the window by exact edit distance (best substring match). A document is contaminated by an item at an edit
similarity of ``SIMILARITY`` or more: 1 - edits / item length, both lower-cased with white space as one space.

The benchmark is a small table by contract; its items are indexed on the driver and sent to the executors only up to
``MOST_ITEM_BYTES``; a larger benchmark is taken in slices of that size, one pass over the documents each. Items of fewer
than ``LEAST_WORDS`` words have no key and are left out; so are null and empty ones. Null and empty
documents match nothing. Repeated documents: one result row each; repeated items: each by its id. Extra columns are
ignored. Empty tables give no matches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import bytesops
from boxwright.llm.store import cut

SIMILARITY, LEAST_WORDS, MOST_ITEM_BYTES = 0.8, 2, 4 << 20
Q = 3
#: Words in over this part of the items are common; of a pair of words one at least is not, if the item has others.
COMMON = 0.04
#: Two sampled steps lie at most so many moves apart.
GAPS = 4
#: Of the grams up to ``AROUND`` code points from a key so many stand within ``SHIFT`` code points of their place.
ALIGNED, AROUND, SHIFT = 0.3, 60, 4
#: Code points that a displacement may be off besides the edits.
OFF = 8
#: Grams are told apart by a hash of so many values.
CODES = 1 << 15
_SPACES = np.zeros(1 << 16, bool)
_SPACES[[k for k in range(1 << 16) if chr(k).isspace()]] = True

_drop = np.ones(256, bool)
_drop[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def symbols(w: bytesops.Words) -> np.ndarray:
    """A hash of each word's letters and digits (lower-cased already); 0 bytes of them: of the word itself."""
    # a polynomial hash over the bytes that stay: marks at both ends are cut off
    keep = ~_drop[w.buf]
    n = len(w.buf)
    at = np.arange(n)
    first = np.minimum.accumulate(np.where(keep, at, n)[::-1])[::-1] if n else at
    last = np.maximum.accumulate(np.where(keep, at, -1)) if n else at
    starts, ends = first[w.starts], last[w.ends - 1] + 1
    bare = starts >= ends
    starts, ends = np.where(bare, w.starts, starts), np.where(bare, w.ends, ends)
    return bytesops.span_hashes(w.buf, starts, ends)


#: A table over the low bits of keys tells most others from an item's at once.
MARKS = np.uint64((1 << 17) - 1)


class Index(NamedTuple):
    """For each gap sorted keys, their first words and a table of the keys' low bits; and of the items' words, their item and where
    each begins in it, in code points. ``grams``: those of all items, each with ``AROUND`` places without one before and after."""

    texts: list[str]
    ids: list[int]
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_of: np.ndarray
    begins: np.ndarray
    grams: np.ndarray
    first_gram: np.ndarray


def build(items: list[tuple[int, str]]) -> Index:
    """The index over (item_id, normalised text)."""
    ids, texts = [i for i, _ in items], [t for _, t in items]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    w = bytesops.split_words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    symbol = symbols(w)
    sets = [frozenset(x.tolist()) for x in np.split(symbol, w.first[1:-1])] if len(ids) else []
    seen = Counter(x for own in sets for x in own)
    most = max(1, int(COMMON * len(sets)))
    rare = [frozenset(x for x in own if seen[x] <= most) for own in sets]
    rare = [r if len(r) >= 4 else own for r, own in zip(rare, sets, strict=True)]
    item_of = bytesops.doc_of(w.first, len(symbol))
    telling = np.array([x in rare[k] for x, k in zip(symbol.tolist(), item_of.tolist(), strict=True)], bool)
    pairs = []
    for gap in range(1, GAPS + 1):
        at, keys = word_pairs(symbol, item_of, gap)
        wanted = telling[at] | telling[at + gap]
        order = np.argsort(keys[wanted], kind="stable")
        keys, at = keys[wanted][order], at[wanted][order]
        marks = np.zeros(int(MARKS) + 1, bool)
        marks[keys & MARKS] = True
        pairs.append((keys, at, marks))
    own = [gram_codes(Points.of(np.frombuffer(r, np.uint8)).text) for r in raw]
    edge = np.full(AROUND, -1, np.int16)
    grams = np.concatenate([edge, *(x for g in own for x in (g, edge))])
    first_gram = AROUND + np.concatenate(([0], np.cumsum([len(g) + AROUND for g in own]))).astype(np.int64)[: len(own)]
    return Index(texts, ids, pairs, item_of, _begins(w, item_of), grams, first_gram)


def _begins(w: bytesops.Words, item_of: np.ndarray) -> np.ndarray:
    place = Points.of(w.buf).place
    return place[w.starts] - place[w.offsets[:-1][item_of]] if len(item_of) else np.zeros(0, np.int64)


def word_pairs(symbol: np.ndarray, text: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(words whose ``gap``-th next word is in the same text, keys of both)."""
    if len(symbol) <= gap:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(text[:-gap] == text[gap:])
    return at, bytesops.mix(symbol[at] * np.uint64(0x9E3779B97F4A7C15) + symbol[at + gap] + np.uint64(gap))


def paired(w: bytesops.Words, index: Index, symbol: np.ndarray) -> np.ndarray:
    """Rows (document, item, word of the group, word of the items) of places that share a pair of words with an item."""
    doc = bytesops.doc_of(w.first, len(symbol))
    out = [np.zeros((0, 4), np.int64)]
    for gap, (known, place, marks) in enumerate(index.pairs, 1):
        if not len(known):
            continue
        at, keys = word_pairs(symbol, doc, gap)
        stay = np.flatnonzero(marks[keys & MARKS])
        at, keys = at[stay], keys[stay]
        low, high = np.searchsorted(known, keys), np.searchsorted(known, keys, side="right")
        n = high - low
        word = place[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]
        at = np.repeat(at, n)
        out.append(np.stack([doc[at], index.item_of[word], at, word], axis=1))
    return np.concatenate(out)


class Points(NamedTuple):
    """The code points of a group's text with white space as one space; and where each byte lies among them."""

    text: np.ndarray
    place: np.ndarray

    @staticmethod
    def of(buf: np.ndarray) -> Points:
        # a byte that is no UTF-8 is a code point of its own
        text = np.frombuffer(buf.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
        bad = (text >= 0xDC80) & (text <= 0xDCFF)
        size = 1 + (text >= 0x80).astype(np.int64) + (text >= 0x800) + (text >= 0x10000) - 2 * bad
        space = _SPACES[np.minimum(text, (1 << 16) - 1)]
        stay = ~(space & np.concatenate(([False], space[:-1]))) if len(text) else space
        return Points(np.where(bad, 0xFFFD, np.where(space, 32, text))[stay].astype(np.uint32), np.repeat(np.cumsum(stay) - 1, size))


def gram_codes(text: np.ndarray) -> np.ndarray:
    """A code under ``CODES`` of each Q-gram of code points."""
    code = np.zeros(max(len(text) - Q + 1, 0), np.uint64)
    for k in range(Q if len(code) else 0):
        code = code * np.uint64(0x9E3779B1) + text[k : k + len(code)]
    return (bytesops.mix(code) & np.uint64(CODES - 1)).astype(np.int16)


def aligned(codes: np.ndarray, first: np.ndarray, end: np.ndarray, at: np.ndarray, index: Index, item_at: np.ndarray, block: int = 2048) -> np.ndarray:
    """For keys at ``codes[at]``, in documents ``codes[first:end]``, and at ``index.grams[item_at]``: which part of the item's grams around
    the key stands in its place."""
    out = np.zeros(len(at))
    near, wide = np.arange(-AROUND, AROUND), np.arange(-AROUND - SHIFT, AROUND + SHIFT)
    for k in range(0, len(at), block):
        s = slice(k, k + block)
        place = at[s, None] + wide
        inside = (place >= first[s, None]) & (place < end[s, None])
        there = np.where(inside, codes[np.clip(place, 0, len(codes) - 1)], np.int16(-2)) if len(codes) else np.full(place.shape, -2, np.int16)
        place = item_at[s, None] + near
        wanted = index.grams[np.clip(place, 0, len(index.grams) - 1)]
        # beyond the edge of the item nothing counts
        gap = wanted < 0
        wanted[:, :AROUND][np.maximum.accumulate(gap[:, AROUND - 1 :: -1], axis=1)[:, ::-1]] = -1
        wanted[:, AROUND:][np.maximum.accumulate(gap[:, AROUND:], axis=1)] = -1
        equal = np.zeros(wanted.shape, bool)
        for shift in range(2 * SHIFT + 1):
            equal |= wanted == there[:, shift : shift + 2 * AROUND]
        out[s] = equal.sum(axis=1) / np.maximum((wanted >= 0).sum(axis=1), 1)
    return out


def best_distance(item: str, text: str, most: int) -> int:
    """Least edits that make ``item`` a substring of ``text`` (bit-parallel dynamic programming over the whole item);
    values over ``most`` may be any over it."""
    n = len(item)
    if not n:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    get = masks.get
    for c in text:
        eq = get(c, 0)
        x = eq | down
        d = ((((x & up) + up) ^ up) | x) & full
        plus = down | ~(d | up) & full
        minus = up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
            if score < best:
                best = score
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | ~(d | plus) & full
        down = plus & d
    return best


def normalise(text: str | None) -> str:
    return " ".join((text or "").encode().lower().decode("utf-8", "replace").split())


def matches(w: bytesops.Words, index: Index) -> dict[tuple[int, int], float]:
    """{(document, item): similarity} of the verified candidates of a group."""
    out: dict[tuple[int, int], float] = {}
    if not len(w.starts) or not len(index.item_of):
        return out
    rows = paired(w, index, symbols(w))
    if not len(rows):
        return out
    points = Points.of(w.buf)
    codes = gram_codes(points.text)
    doc, item, at = rows[:, 0], rows[:, 1], points.place[w.starts[rows[:, 2]]]
    first = points.place[w.starts[w.first[doc]]]
    end = points.place[w.ends[w.first[doc + 1] - 1] - 1] + 1
    begin = index.begins[rows[:, 3]]
    part = aligned(codes, first, end - Q + 1, at, index, index.first_gram[item] + begin)
    short = np.array([len(t) for t in index.texts])[item] < 2 * Q
    good = np.flatnonzero((part >= ALIGNED) | short)
    order = good[np.lexsort((at[good] - begin[good], -part[good], item[good], doc[good]))]
    tried: list[int] = []
    last = None
    for d, i, displaced, lo, hi in np.stack([doc, item, at - begin, first, end], axis=1)[order].tolist():
        if (d, i) != last:
            last, tried = (d, i), []
        text = index.texts[i]
        n, most = len(text), int((1 - SIMILARITY) * len(text) + 1e-9)
        # a window that lies in one already held against the item
        if any(abs(displaced - t) <= OFF for t in tried) or out.get((d, i), 0.0) >= 1.0:
            continue
        tried.append(displaced)
        window = points.text[max(lo, displaced - most - 2 * OFF) : min(hi, displaced + n + most + 2 * OFF)].tobytes().decode("utf-32-le", "replace")
        edits = best_distance(text, window, most)
        if edits <= most:
            out[d, i] = max(out.get((d, i), 0.0), 1 - edits / n)
    return out


def item_slices(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's usable items in slices of bounded size, in the order of their ids."""
    now, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").orderBy("item_id", "text")
    for item_id, text in rows.toLocalIterator():
        text = normalise(text)
        if len(text.split()) < LEAST_WORDS:
            continue
        if now and size + len(text) > MOST_ITEM_BYTES:
            yield now
            now, size = [], 0
        now.append((item_id, text))
        size += len(text)
    if now:
        yield now


def _matching(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    index = build(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at, _, w in bytesops.words_in(b.column(1), lower=True):
                found = matches(w, index)
                yield pa.RecordBatch.from_arrays([pa.array([doc_ids[at + d] for d, _ in found], pa.int64()), pa.array([index.ids[i] for _, i in found], pa.int64()), pa.array(list(found.values()), pa.float64())], names=["doc_id", "item_id", "similarity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, item_id long, similarity double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity) of every document that has an item's passage."""
    out = None
    for items in item_slices(benchmark):
        part = _matching(docs, items)
        out = part if out is None else out.union(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double")
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def verdicts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, n_items, best_item (smallest id of the highest similarity), similarity."""
    pairs = contaminated(docs, benchmark)
    best = pairs.groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max(F.struct("similarity", (-F.col("item_id")).alias("item"))).alias("best"))
    best = best.select("doc_id", "n_items", (-F.col("best.item")).alias("best_item"), F.col("best.similarity").alias("similarity"))
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(best, "doc_id", "left")
    return joined.select("doc_id", F.col("best_item").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "best_item", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a passage of the benchmark, all columns as they are."""
    hit = cut(contaminated(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct(), "decontaminate-hits")
    return docs.join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
