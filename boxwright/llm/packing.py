"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

A document's ids are those of its tokenizer and one end id. Documents longer than a sequence are cut into full pieces
and one shorter last piece. The pieces' length histogram (at most ``capacity`` numbers) is all that the driver sees.
There a configuration linear program (configurations: multisets of lengths that fit a sequence; each length to be
covered) is solved by multiplicative weights, each round pricing a configuration by knapsack dynamic programming. It is
rounded to whole numbers of sequences; what rounding leaves is packed by best fit, a whole pattern at a time, so the
plan has at most ``ROUNDS`` + 2 * ``capacity`` patterns however many pieces there are. Executors then hand out places:
a piece's rank among those of its length picks its place.

Null and empty texts have the end id alone and take a place. Repeated rows are packed each. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxwright.llm import bytesops
from boxwright.llm.store import cut

CAPACITY, END_ID = 2048, 0
#: Rounds of multiplicative weights, and the weights' step.
ROUNDS, STEP = 400, 1.2
#: Units that a Python worker keeps the ids of.
CACHE_UNITS = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 punctuation, 3 anything else."""
    out = np.full(256, 3, np.uint8)
    out[[32, *range(9, 14)]] = 0
    out[[*range(65, 91), *range(97, 123)]] = 1
    out[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<"]] = 2
    return out


CLASSES = _classes()


class WordIds:
    """Ids of the units of texts, kept between calls.

    The tokenizer drops white space, takes lower case and then splits runs of letters from runs of marks. A unit is such
    a run of ASCII or Latin-1 letters, or of ASCII marks; a white-space-separated word with anything else in it
    (digits, apostrophes, other scripts, special tokens) is one unit as it stands. Units are found, hashed to 64 bits
    and looked up a group of texts at a time; only new ones reach the tokenizer.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        from tokenizers import Tokenizer

        self.tokenizer, self.separator = Tokenizer.from_file(path), separator
        self.separator_id = self.tokenizer.token_to_id(separator)
        self.clear()

    def clear(self) -> None:
        self.keys, self.values = np.zeros(1 << 18, np.uint64), np.zeros(1 << 18, np.int32)
        self.starts, self.sizes, self.count = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64), 1
        self.pool, self.used = np.full(1 << 19, END_ID, np.uint32), 1  # unit 0 is the end id
        self.sizes[0] = 1

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's unit, -1 for none."""
        mask = np.uint64(len(self.keys) - 1)
        slot = (hashes & mask).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == hashes, self.values[slot], -1)
        open_ = np.flatnonzero((held != hashes) & (held != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & int(mask)
            held = self.keys[slot[open_]]
            hit = held == hashes[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
        return out

    def _place(self, hashes: np.ndarray, units: np.ndarray) -> None:
        """``hashes``: distinct and new."""
        if 2 * (self.count + len(hashes)) > len(self.keys):
            old = self.keys != 0
            keys, values = self.keys[old], self.values[old]
            size = len(self.keys)
            while 2 * (self.count + len(hashes)) > size:
                size *= 2
            self.keys, self.values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._place(keys, values)
        mask = len(self.keys) - 1
        slot = (hashes & np.uint64(mask)).astype(np.int64)
        left = np.arange(len(hashes))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            at, own = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = hashes[free[own]], units[free[own]]
            left = left[self.keys[slot[left]] != hashes[left]]
            slot[left] = (slot[left] + 1) & mask

    def _encode(self, parts: list[str]) -> list[list[int]]:
        found: list[list[int]] = []
        for at in range(0, len(parts), 4096):
            some = parts[at : at + 4096]
            if any("<|" in p for p in some):
                found += [self.tokenizer.encode(p, add_special_tokens=False).ids for p in some]
                continue
            ids = np.array(self.tokenizer.encode(self.separator.join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(ids == self.separator_id)
            found += [x[1:] if k else x for k, x in enumerate(np.split(ids, ends))]
        return found

    def _learn(self, hashes: np.ndarray, parts: list[str]) -> None:
        ids = self._encode(parts)
        sizes = np.array([len(x) for x in ids], np.int64)
        total, n = int(sizes.sum()), len(parts)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        while self.count + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + total] = np.concatenate([np.asarray(x, np.uint32) for x in ids]) if n else ()
        self.starts[self.count : self.count + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.count : self.count + n] = sizes
        self._place(hashes, np.arange(self.count, self.count + n, dtype=np.int32))
        self.count, self.used = self.count + n, self.used + total

    @staticmethod
    def units(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in lower case, starts, ends) of the units of texts ``buf[offsets[i]:offsets[i + 1]]``."""
        kind, low = CLASSES[buf], bytesops.lower_ascii(buf)
        lead = np.flatnonzero(buf[:-1] == 0xC3)
        after = buf[lead + 1]
        lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        upper = lead[buf[lead + 1] <= 0x9E] + 1
        low[upper] += 0x20
        w = bytesops.split_words(buf, offsets)
        odd = np.concatenate(([0], np.cumsum(kind == 3)))
        odd = np.flatnonzero(odd[w.ends] > odd[w.starts])
        if len(odd):
            inside = np.zeros(len(buf) + 1, np.int8)
            np.add.at(inside, w.starts[odd], 1)
            np.add.at(inside, w.ends[odd], -1)
            inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
            kind[inside] = 3
            low[inside] = buf[inside]
        change = np.ones(len(buf) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[offsets] = True
        edges = np.flatnonzero(change)
        solid = kind[edges[:-1]] != 0
        return low, edges[:-1][solid], edges[1:][solid]

    def ids(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each text and the end); every text ends with the end id."""
        low, starts, ends = self.units(buf, offsets) if len(buf) else (buf, np.zeros(0, np.int64), np.zeros(0, np.int64))
        hashes = np.maximum(bytesops.span_hashes(low, starts, ends), np.uint64(1))
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            if self.count + len(missing) > CACHE_UNITS:
                self.clear()
                missing = np.arange(len(hashes))
            new, first = np.unique(hashes[missing], return_index=True)
            first, raw = missing[first], low.tobytes()
            self._learn(new, [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            found[missing] = self._find(hashes[missing])
        # the end id after each text's units
        own = np.insert(found.astype(np.int64), np.searchsorted(starts, offsets[1:]), 0)
        sizes = self.sizes[own]
        after = np.cumsum(sizes)
        at = np.arange(after[-1] if len(after) else 0) + np.repeat(self.starts[own] - (after - sizes), sizes)
        last = np.searchsorted(starts, offsets[1:]) + np.arange(len(offsets) - 1)
        return self.pool[at], np.concatenate(([0], after[last]))


_kept: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _kept:
        _kept[path] = WordIds(path)
    return _kept[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32; part and nth number the pieces of a length in each
    task. ``with_ids`` adds the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part, nth = word_ids(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, offsets = bytesops.binary_parts(batch.column(1))
            for at, to in bytesops.groups(offsets):
                group = batch.slice(at, to - at)
                ids, first = known.ids(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
                sizes = np.diff(first)
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                begin = first[:-1][doc] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                ranked, run_start = length[order], np.zeros(len(order), np.int64)
                new = np.flatnonzero(np.diff(ranked, prepend=-1))
                run_start[new] = new
                own = np.empty(len(order), np.int64)
                own[order] = np.arange(len(order)) - np.maximum.accumulate(run_start) + nth[ranked]
                nth += np.bincount(length, minlength=capacity + 1)
                columns = [group.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(own)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    columns.append(pa.array([ids[b : b + n].astype(np.int64) for b, n in zip(begin, length, strict=True)], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


def best_configuration(value: np.ndarray, capacity: int) -> list[int]:
    """Lengths (repeats allowed) of the most valuable multiset that fits; ``value[l]``: of a length, 0 for none."""
    lengths = np.flatnonzero(value > 0)
    if not len(lengths):
        return []
    worth, best, pick = value[lengths], np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        n = fits[c]
        total = best[c - lengths[:n]] + worth[:n]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], pick[c] = total[k], lengths[k]
        else:
            best[c] = best[c - 1]
    out, c = [], capacity
    while c > 0:
        if pick[c]:
            out.append(int(pick[c]))
            c -= int(pick[c])
        else:
            c -= 1
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: pieces}, sequences) that hold every piece of ``histogram`` exactly once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[dict[int, int], int]] = []
    if left[capacity]:
        out.append(({capacity: 1}, int(left[capacity])))
        left[capacity] = 0
    need = left.astype(float)
    used = need > 0
    # covering program: weights fall with the share of a length that is covered; at first a token is worth a token
    logs = np.zeros(capacity + 1)
    share, amount = np.arange(capacity + 1, dtype=float), {}
    covered = np.zeros(capacity + 1)
    for _ in range(rounds if used.any() else 0):
        value = np.where(used & (covered < need), share * np.exp(logs), 0.0)
        chosen = best_configuration(value, capacity)
        if not chosen:
            break
        lengths, n = np.unique(chosen, return_counts=True)
        step = max(1.0, float(np.min((need[lengths] - covered[lengths]) / n)) / 2)
        key = tuple(zip(lengths.tolist(), n.tolist(), strict=True))
        amount[key] = amount.get(key, 0.0) + step
        covered[lengths] += n * step
        logs[lengths] -= STEP * np.minimum(n * step / need[lengths], 1.0)
        logs -= logs[used].max()
    for key, x in sorted(amount.items(), key=lambda kx: (-sum(length * k for length, k in kx[0]), -kx[1], kx[0])):
        most = min(int(left[length]) // k for length, k in key)
        times = min(most, max(1, int(x)))
        if times > 0 and sum(length * k for length, k in key) == capacity:
            out.append((dict(key), times))
            for length, k in key:
                left[length] -= k * times
    return out + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The rest, largest first: each pattern is filled by the subset of what is left that fits best, and repeated for
    as long as that lasts; so each pattern uses up a length."""
    out = []
    while left.any():
        first = int(np.flatnonzero(left)[-1])
        pattern, room = {first: 1}, capacity - first
        while room > 0:
            n = left[: room + 1].copy()
            for length, k in pattern.items():
                if length <= room:
                    n[length] -= k
            fits = np.flatnonzero(n > 0)
            if not len(fits):
                break
            # two pieces that fill the room exactly, or else the largest that fits
            pair = fits[np.isin(room - fits, fits)]
            pair = pair[(2 * pair != room) | (n[pair] > 1)]
            take = int(pair[-1]) if len(pair) and fits[-1] != room else int(fits[-1])
            pattern[take] = pattern.get(take, 0) + 1
            room -= take
        times = max(1, min(int(left[length]) // k for length, k in pattern.items()))
        out.append((pattern, times))
        for length, k in pattern.items():
            left[length] -= k * times
    return out


def runs(patterns: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Columns length, first rank, first sequence, pieces a sequence, offset: a run of ranks of a length and its places."""
    rows, given, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length, k in sorted(pattern.items(), reverse=True):
            rows.append((length, given.get(length, 0), sequence, k, offset))
            given[length] = given.get(length, 0) + k * times
            offset += k * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a materialised :func:`pieces`."""
    per_task = cut(cut_pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "packing-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = runs(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_pieces.join(offsets, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).drop("before", "part")
    names = [c for c in ranked.columns if c != "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = places[:, 0] << 44 | places[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "nth"))
            own = places[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            number = rank - own[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(own[:, 2] + number // own[:, 3]), pa.array(own[:, 4] + number % own[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "nth")
    return ranked.mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(cut(pieces(docs, tokenizer, capacity), "packing-pieces"), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A group holds at most ``capacity`` ids."""
    placed = pack(cut(pieces(docs, tokenizer, capacity, with_ids=True), "packing-ids"), capacity)
    whole = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(whole, lambda x: x["ids"])).alias("ids"))
