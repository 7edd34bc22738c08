"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax.

Words are leaves of nested classes of ``WIDTH`` each: P(word | history) is the product of P(class | the classes above it, history) over
``LEVELS`` levels, times the word's share of its last class. Every factor is a softmax over hashed features: the word before, the two words before, skips over
one and two words, and the suffix classes of the word before and of the one before that (below the second level: the word before, its suffix
class and a skip over one word). The upper two levels hold the end of a
text, the ``OWN`` most frequent words, one class each, and classes by the last bytes of a word; the lower two split these by the word
itself, so a last class has few frequent words. The share in a last class is a discounted one; what is discounted is the
probability of unseen words, one symbol a class. Weights are a table whose rows grow with the distinct words of the training
texts (``ROWS_A_WORD`` to a word), within ``ROWS``.

Training covers all training texts twice: one pass counts (feature, class) and what the classes' shares alone would give, whose log ratio is
where the weights begin; then ``ROUNDS`` distributed gradient updates follow, each over its own slice of the texts (by hash of the id), all slices
together are all of them. Tasks sum observed and expected counts, blocks of rows are summed by key, and the step is scaled by the expected
count. Word counts stay a distributed table; only words over a count that at most ``HEAD`` words reach are sent to
executors, the others' counts are joined to the (document, word) rows that need them.

A text trains if crc32 of its id modulo 10 is not 0. Words are told apart by 64-bit hashes. Null and empty texts are the end token alone.
Repeated rows: one result row each. No training text: every word is unseen. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwright.llm import bytesops
from boxwright.llm.store import cut

WIDTH, LEVELS, OWN = 16, 4, 95
#: Rows of the weights' table: fewest and most, and rows to a distinct training word.
ROWS, ROWS_A_WORD = (1 << 14, 1 << 18), 4
HEAD, DISCOUNT = 1 << 17, 0.5
ROUNDS, RATE, FIRST, PRIOR, KAPPA = 4, 0.5, 0.35, 10.0, 4.0
#: A weight's largest amount: six of them stay far within what a float32 exponential holds.
FARTHEST = 10.0
BLOCK, TOKENS, TASK_TOKENS = 256, 1 << 13, 1 << 22
#: Bytes of texts handled at once: many where words are counted, fewer elsewhere, so that what a choice needs stays in a core's cache.
GROUP_BYTES, PART_BYTES = 1 << 20, 1 << 17
#: Features of each level.
FEATURES = (6, 6, 3, 3)
#: Hashes of the end token and of what precedes a text.
END, BEFORE = np.uint64(1), np.uint64(2)
_ONES = np.ones(WIDTH, np.float32)
_CODES = WIDTH * WIDTH
_N_SUFFIX = _CODES - 1 - OWN
#: First node of each level; a node is a softmax over WIDTH classes.
_NODES = (0, 1, 1 + WIDTH, 1 + WIDTH + _CODES, 1 + WIDTH + _CODES + _CODES * WIDTH)
#: What tells a feature's rows at different nodes apart.
_SALTS = (bytesops.mix(np.arange(_NODES[-1], dtype=np.uint64) + np.uint64(1)) >> np.uint64(32)).astype(np.uint32)
_ODD = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint32(0x9E3779B1))
#: Frequent words are looked up by so many leading bits of their hashes.
LEADING = 17


class Tokens(NamedTuple):
    """A group's tokens, each text's end included: hash, class by suffix (0 for the end), text."""

    hashes: np.ndarray
    suffix: np.ndarray
    doc: np.ndarray


def tokens(w: bytesops.Words) -> Tokens:
    hashes = np.maximum(bytesops.span_hashes(w.buf, w.starts, w.ends), np.uint64(16))
    size = w.ends - w.starts
    code = np.zeros(len(size), np.int64)
    for k in (1, 2, 3):
        code = code * 257 + np.where(size >= k, w.buf[np.maximum(w.ends - k, 0)].astype(np.int64) + 1, 0) if len(size) else code
    suffix = 1 + OWN + (code * 0x9E3779B1 & 0xFFFFFFFF) % _N_SUFFIX
    ends = w.first[1:]
    doc = np.insert(bytesops.doc_of(w.first, len(size)), ends, np.arange(len(ends)))
    return Tokens(np.insert(hashes, ends, END), np.insert(suffix, ends, 0), doc)


def slots(hashes: np.ndarray) -> np.ndarray:
    """A word's place in the lower two levels."""
    return ((hashes >> np.uint64(20)) & np.uint64(_CODES - 1)).astype(np.int64)


def history(t: Tokens) -> list[np.ndarray]:
    """The 32-bit hashes of each token's features; the first three are those of the lower levels."""

    def back(values: np.ndarray, k: int, none: np.uint64) -> np.ndarray:
        out = np.full(len(values), none, np.uint64)
        if len(out) > k:
            out[k:] = np.where(t.doc[k:] == t.doc[:-k], values[:-k], none)
        return out

    one, two, three = (back(t.hashes, k, BEFORE) for k in (1, 2, 3))
    kinds = (t.suffix.astype(np.uint64) + np.uint64(1)) << np.uint64(32)
    found = [one, back(kinds, 1, BEFORE), two, back(kinds, 2, BEFORE), one * np.uint64(0x9E3779B97F4A7C15) + two, three]
    return [((h + np.uint64(1000 * (k + 1))) * _ODD[0] >> np.uint64(32)).astype(np.uint32) for k, h in enumerate(found)]


class Decisions(NamedTuple):
    """Choices at one level: which tokens, their nodes, the classes chosen and the rows of their features (choices, features)."""

    token: np.ndarray
    node: np.ndarray
    chosen: np.ndarray
    rows: np.ndarray


def decisions(codes: np.ndarray, slot: np.ndarray, features: list[np.ndarray], size: int) -> Iterator[Decisions]:
    """The choices that lead to each token's last class; words with a class of their own make two. ``size``: rows of the table."""
    deep = np.flatnonzero(codes > OWN)
    every = np.arange(len(codes))
    own, low, some, shift = codes, slot, features, np.uint32(33 - size.bit_length())
    for level in range(LEVELS):
        token = every if level < 2 else deep
        if level == 2:
            own, low, some = codes[deep], slot[deep], [f[deep] for f in features[: FEATURES[2]]]
        above = (np.zeros(len(token), np.int64), own // WIDTH, own, own * WIDTH + low // WIDTH)[level]
        chosen = (own // WIDTH, own % WIDTH, low // WIDTH, low % WIDTH)[level]
        node = above + _NODES[level]
        salt = _SALTS.take(node)
        rows = np.empty((FEATURES[level], len(token)), np.intp)
        for k in range(FEATURES[level]):
            rows[k] = (some[k] ^ salt) * _ODD[1] >> shift
        yield Decisions(token, node, chosen, rows.T)


class Words(NamedTuple):
    """Frequent words: sorted hashes, counts, and the class of those with one of their own (else -1); and totals by last class
    (class * 256 + slot)."""

    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray
    total: int
    distinct: int
    leaf_total: np.ndarray
    leaf_distinct: np.ndarray
    #: How many rows the weights have.
    rows: int

    def begins(self) -> np.ndarray:
        """Where the hashes of each beginning of ``LEADING`` bits begin."""
        return np.searchsorted(self.hashes, np.arange(1 << LEADING, dtype=np.uint64) << np.uint64(64 - LEADING))

    def find(self, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Each hash's place, -1 for none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        last = len(self.hashes) - 1
        at = np.minimum(begins.take((hashes >> np.uint64(64 - LEADING)).view(np.int64)), last)
        there = self.hashes.take(at)
        # some words begin alike
        ahead = np.flatnonzero(there < hashes)
        while len(ahead):
            at[ahead] = np.minimum(at[ahead] + 1, last)
            there[ahead] = self.hashes.take(at[ahead])
            ahead = ahead[(there[ahead] < hashes[ahead]) & (at[ahead] < last)]
        return np.where(there == hashes, at, -1)

    def classes(self, t: Tokens, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class of the upper levels, slot in the lower ones: 0 for words of their own class)."""
        own = np.where(at >= 0, self.own[at], -1) if len(self.own) else np.full(len(at), -1)
        codes = np.where(own >= 0, own, t.suffix)
        return codes, np.where(codes > OWN, slots(t.hashes), 0)

    @property
    def base_divisor(self) -> float:
        return self.total + 0.1 * (self.distinct + 1)

    def unseen(self) -> np.ndarray:
        """log10 P(unseen | last class)."""
        n = self.leaf_total
        return np.log10(np.where(n > 0, DISCOUNT * self.leaf_distinct / np.maximum(n, 1), 1.0).clip(1e-300))

    def shares(self) -> np.ndarray:
        """Natural logarithm of each class's share of its node: (nodes, WIDTH)."""
        low = self.leaf_total.reshape(_CODES * WIDTH, WIDTH)
        code = low.sum(axis=1).reshape(_CODES, WIDTH)
        top = code.sum(axis=1).reshape(WIDTH, WIDTH)
        n = np.concatenate((top.sum(axis=1)[None], top, code, low)) + 0.5
        return np.log(n / n.sum(axis=1, keepdims=True)).astype(np.float32)


def _input(docs: DataFrame) -> DataFrame:
    trains = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0, F.lit(True))
    slice_ = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(ROUNDS)).cast("int")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), trains.alias("trains"), slice_.alias("slice"))


def _groups(b: pa.RecordBatch, limit: int) -> Iterator[tuple[int, int, Tokens]]:
    for at, to, w in bytesops.words_in(b.column(1), lower=True, limit=limit):
        yield at, to, tokens(w)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, suffix, c) of the training texts' tokens; counted in each group of texts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, t in _groups(b, GROUP_BYTES):
                order = np.argsort(t.hashes)
                hashes = t.hashes[order]
                first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else order
                n = np.diff(np.append(first, len(hashes)))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[first].view(np.int64)), pa.array(t.suffix[order[first]].astype(np.int32)), pa.array(n)], names=["h", "suffix", "c"])

    return _input(docs).where("trains").mapInArrow(run, "h long, suffix int, c long").groupBy("h", "suffix").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, most: int | None = None) -> Words:
    """From the materialised counts: words over a count that at most ``most`` words reach. The driver gets those, a
    histogram of 16 steps an octave, and totals by last class (65,536 at most)."""
    step = F.floor(F.log2("c") * 16)
    histogram = sorted((int(k), int(n)) for k, n in counts.groupBy(step).agg(F.count("*")).collect())
    reached, least = 0, 1 << 40
    for k, n in reversed(histogram):
        reached += n
        if reached > (HEAD if most is None else most):
            break
        least = k
    top = counts.where(step >= least).toArrow()
    hashes, c = top.column("h").to_numpy().view(np.uint64), top.column("c").to_numpy()
    suffix = top.column("suffix").to_numpy().astype(np.int64)
    order = np.argsort(hashes)
    hashes, c, suffix = hashes[order], c[order].astype(np.int64), suffix[order]
    leaf_total, leaf_distinct = np.zeros(_CODES * _CODES), np.zeros(_CODES * _CODES)
    slot = F.when(F.col("suffix") > OWN, F.shiftrightunsigned("h", 20).bitwiseAND(F.lit(_CODES - 1))).otherwise(F.lit(0))
    for leaf, t, v in counts.groupBy((F.col("suffix") * _CODES + slot).alias("leaf")).agg(F.sum("c"), F.count("*")).collect():
        leaf_total[leaf], leaf_distinct[leaf] = t, v
    own = np.where(hashes == END, 0, -1)
    for k, at in enumerate([a for a in np.lexsort((hashes, -c)) if hashes[a] != END][:OWN]):
        own[at] = 1 + k
        leaf = suffix[at] * _CODES + slots(hashes[at : at + 1])[0]
        leaf_total[leaf] -= c[at]
        leaf_distinct[leaf] -= 1
        leaf_total[(1 + k) * _CODES], leaf_distinct[(1 + k) * _CODES] = c[at], 1
    distinct = int(leaf_distinct.sum())
    rows = min(max(1 << (distinct * ROWS_A_WORD).bit_length(), ROWS[0]), ROWS[1])
    return Words(hashes, c, own, int(leaf_total.sum()), distinct, leaf_total, leaf_distinct, rows)


def _summed(rows: DataFrame, size: int) -> np.ndarray:
    """Sums matrices of ``size`` rows that tasks give as (block, bytes of float32)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # dealt by block: a task adds up a few blocks of a fixed size
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float32).astype(np.float64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.float32).tobytes() for s in sums.values()], pa.binary())], names=["block", "part"])

    out = np.zeros((size, WIDTH), np.float32)
    summed = cut(rows.repartition("block").mapInArrow(add, "block int, part binary"), "lm-sums")
    for block, raw in summed.toLocalIterator():
        out[block * BLOCK : (block + 1) * BLOCK] += np.frombuffer(raw, np.float32).reshape(-1, WIDTH)
    return out


def _blocks(matrix: np.ndarray, first: int = 0) -> Iterator[pa.RecordBatch]:
    """The blocks that are not empty, some at a time."""
    used = [k for k in range(len(matrix) // BLOCK) if matrix[k * BLOCK : (k + 1) * BLOCK].any()]
    for at in range(0, len(used), 128):
        some = used[at : at + 128]
        yield pa.RecordBatch.from_arrays([pa.array([first + k for k in some], pa.int32()), pa.array([matrix[k * BLOCK : (k + 1) * BLOCK].tobytes() for k in some], pa.binary())], names=["block", "part"])


class Model(NamedTuple):
    """``bias``: (nodes, WIDTH), ``weights``: (rows, WIDTH)."""

    bias: np.ndarray
    weights: np.ndarray

    def logits(self, d: Decisions) -> np.ndarray:
        """(choices, WIDTH). Weights are within ``FARTHEST``, so exponentials need no shift."""
        logit = self.bias.take(d.node, axis=0)
        part = np.empty_like(logit)
        for k in range(d.rows.shape[1]):
            np.take(self.weights, d.rows[:, k], axis=0, out=part, mode="clip")  # no row is out of range; this mode needs no copy
            logit += part
        return logit

    def probabilities(self, d: Decisions) -> np.ndarray:
        """(choices, WIDTH)."""
        p = self.logits(d)
        np.exp(p, out=p)
        p *= (1 / (p @ _ONES))[:, None]
        return p

    def log_probabilities(self, d: Decisions) -> np.ndarray:
        """(choices, WIDTH), natural logarithm."""
        logit = self.logits(d)
        logit -= np.log(np.exp(logit) @ _ONES)[:, None]
        return logit

    def log_chosen(self, d: Decisions) -> np.ndarray:
        """Of :meth:`log_probabilities` those of the classes chosen."""
        logit = self.logits(d)
        own = logit[np.arange(len(logit)), d.chosen]
        np.exp(logit, out=logit)
        return own - np.log(logit @ _ONES)


def _parts(t: Tokens, words: Words, at: np.ndarray) -> Iterator[tuple[slice, list[Decisions]]]:
    """The choices of a group, ``TOKENS`` tokens at a time. ``at``: the places of its words."""
    codes, slot = words.classes(t, at)
    features = history(t)
    for begin in range(0, len(codes), TOKENS):
        s = slice(begin, begin + TOKENS)
        yield s, list(decisions(codes[s], slot[s], [f[s] for f in features], words.rows))


def _add(into: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``into[rows] += values``, with repeats."""
    # two neighbouring numbers are added at once, as the parts of a complex one
    half = WIDTH // 2
    at, first = np.empty((len(rows), half), np.intp), rows * half
    for k in range(half):
        np.add(first, k, out=at[:, k])
    np.add.at(into.view(np.complex64).reshape(-1), at.reshape(-1), values.view(np.complex64).reshape(-1))


def moments(docs: DataFrame, words: Words, model: Model, turn: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(observed, expected) counts of (feature row, class) over the training texts under weights of 0, or over a slice of them."""
    shared, size = docs.sparkSession.sparkContext.broadcast((words, model)), words.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = shared.value
        begins = known.begins()
        seen, expected = np.zeros(size * WIDTH, np.float32), np.zeros((size, WIDTH), np.float32)
        # before the first step a choice's probabilities are its node's shares: of the few upper nodes it is enough to count choices
        shares, upper = np.exp(now.bias), np.zeros(size * _NODES[2] if turn is None else 0, np.float32)
        for b in batches:
            for _, _, t in _groups(b, PART_BYTES):
                for _, choices in _parts(t, known, known.find(t.hashes, begins)):
                    for level, d in enumerate(choices):
                        if not len(d.token):
                            continue
                        few = turn is None and level < 2
                        p = None if few else shares.take(d.node, axis=0) if turn is None else now.probabilities(d)
                        for k in range(d.rows.shape[1]):
                            row = d.rows[:, k]
                            np.add.at(seen, row * WIDTH + d.chosen, np.float32(1))
                            if few:
                                np.add.at(upper, row * _NODES[2] + d.node, np.float32(1))
                            else:
                                _add(expected, row, p)
        if turn is None:
            for at in range(0, size, 1 << 14):
                expected[at : at + (1 << 14)] += upper.reshape(size, -1)[at : at + (1 << 14)] @ shares[: _NODES[2]]
        yield from _blocks(seen.reshape(size, WIDTH))
        yield from _blocks(expected, size // BLOCK)

    texts = _input(docs).where("trains" if turn is None else F.expr(f"trains AND slice = {turn}"))
    # each task gives a whole table, so small pieces of the input share one: a task for so many tokens, or for each core if these are more
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-words.total // TASK_TOKENS))
    both = _summed(texts.coalesce(tasks).mapInArrow(run, "block int, part binary"), 2 * size)
    shared.unpersist()
    return both[:size], both[size:]


def train(docs: DataFrame, words: Words) -> Model:
    model = Model(words.shares(), np.zeros((words.rows, WIDTH), np.float32))
    seen, expected = moments(docs, words, model)
    # the classes' shares as a row's texts have them stand in for what was not seen
    n = np.maximum(expected.sum(axis=1, keepdims=True), 1e-9)
    share = np.maximum(expected / n, 1e-9)
    first = np.log((seen + PRIOR * share) / ((n + PRIOR) * share))
    model = Model(model.bias, np.clip(FIRST * first, -FARTHEST, FARTHEST).astype(np.float32))
    for turn in range(ROUNDS):
        seen, expected = moments(docs, words, model, turn)
        step = RATE * np.clip((seen - expected) / (expected + KAPPA), -1.0, 2.0)
        model = Model(model.bias, np.clip(model.weights + step / (1 + turn / 2), -FARTHEST, FARTHEST).astype(np.float32))
    return model


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, h array<long>, seen array<double>, unseen array<double>, tf array<long>"


def score(docs: DataFrame, words: Words, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast((words, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, now = shared.value
        begins, rid = known.begins(), TaskContext.get().partitionId() << 40
        base_of = np.log10((known.counts + 0.1) / known.base_divisor)
        unseen, of_leaf = known.unseen(), np.log10(np.maximum(known.leaf_total, 1))
        for b in batches:
            held = ~b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for lo, to, t in _groups(b, PART_BYTES):
                n = to - lo
                at = known.find(t.hashes, begins)
                codes, slot = known.classes(t, at)
                leaf = codes * _CODES + slot
                value = np.zeros(len(codes))
                for s, choices in _parts(t, known, at):
                    for d in choices:
                        if len(d.token):
                            value[s.start + d.token] += now.log_chosen(d)
                value /= np.log(10)
                head = at >= 0
                value[head] += np.log10(known.counts[at[head]] - DISCOUNT) - of_leaf[leaf[head]]
                base = np.where(head, base_of[np.maximum(at, 0)], 0.0) if len(base_of) else np.zeros(len(at))
                # the others, each once a text
                tail = np.flatnonzero(~head)
                order = tail[np.lexsort((t.hashes[tail], t.doc[tail]))]
                new = np.ones(len(order), bool)
                new[1:] = (t.doc[order][1:] != t.doc[order][:-1]) | (t.hashes[order][1:] != t.hashes[order][:-1])
                new = np.flatnonzero(new)
                one, tf = order[new], np.diff(np.append(new, len(order)))
                offsets = pa.array(np.searchsorted(t.doc[one], np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (t.hashes[one].view(np.int64), of_leaf[leaf[one]], unseen[leaf[one]], tf.astype(np.int64))]
                per_doc = lambda weights=None: np.bincount(t.doc, weights=weights, minlength=n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(rid, rid + n)), b.column(0).slice(lo, n), pa.array(held[lo:to]), pa.array(per_doc().astype(np.int64)), pa.array(per_doc(head).astype(np.int64)), pa.array(per_doc(base)), pa.array(per_doc(value)), *lists],
                    names=[c.split()[0] for c in SCORED.split(", ")],
                )
                rid += n

    texts = cut(_input(docs).mapInArrow(run, SCORED), "lm-texts")
    rare = texts.select("rid", F.explode(F.arrays_zip("h", "seen", "unseen", "tf")).alias("t")).select("rid", "t.h", F.col("t.seen").alias("of_leaf"), "t.unseen", "t.tf")
    got = rare.join(counts.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    seen = F.col("c") > 0
    word = F.when(seen, F.log10(F.col("c") - DISCOUNT) - F.col("of_leaf")).otherwise(F.col("unseen"))
    sums = got.groupBy("rid").agg(
        F.sum(F.when(seen, F.col("tf")).otherwise(0)).alias("known_rare"),
        F.sum(F.col("tf") * F.log10((F.col("c") + 0.1) / F.lit(words.base_divisor))).alias("base_rare"),
        F.sum(F.col("tf") * word).alias("score_rare"),
    )
    zero = F.lit(0)
    return (
        texts.drop("h", "seen", "unseen", "tf")
        .join(sums, "rid", "left")
        .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rare", zero)).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("base_rare", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("score_rare", F.lit(0.0))).alias("score"))
    )


def lm_scores(docs: DataFrame) -> DataFrame:
    counts = cut(word_counts(docs), "lm-counts")
    words = frequent_words(counts)
    return score(docs, words, train(docs, words), counts)
