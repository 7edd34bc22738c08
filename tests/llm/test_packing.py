import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from boxwright.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t", "don't IT'S 'll naïve Ünïcode É x", "İstanbul ŉ ΣΑΣ ſ K", "日本語 テスト ①½ a​b ﬁ", "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "é É 12ab 3.14 $$$ ###,", "x" * 3000, "a\x00b \x1c c d e", "🙂👍🏽 ok"]


def expected(text):
    tok = Tokenizer.from_file(PATH)
    return tok.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, got, capacity):
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for doc_id, text in rows:
        ids = expected(text)
        own = sorted(by_doc.pop(doc_id), key=lambda r: r.piece)
        assert len(own) == -(-len(ids) // capacity)
        for k, r in enumerate(own):
            part = ids[k * capacity : (k + 1) * capacity]
            assert (r.piece, r.start, r.length) == (k, k * capacity, len(part))
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert not by_doc
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_pack_documents(spark):
    r = random.Random(5)
    words = [r.choice(["the", "Walk,", "éa", "x1", "long-ish", "ß", "O'Neil"]) + r.choice(["", ".", "!!", "###"]) for _ in range(300)]
    rows = list(enumerate(ODD + [" ".join(r.choice(words) for _ in range(r.choice([1, 5, 30, 90, 400]))) for _ in range(120)]))
    rows.append((10_000, rows[-1][1]))  # a copy
    docs = spark.createDataFrame([(d, t, 7, "clash") for d, t in rows], "doc_id long, text string, piece int, sequence_id string").repartition(3)
    got = packing.pack_documents(docs, PATH, 64).collect()
    n = check(rows, got, 64)
    assert n <= -(-sum(x.length for x in got) // 64) + 2
    whole = packing.sequences(docs, PATH, 64).collect()
    assert len(whole) == n and sum(len(x.ids) for x in whole) == sum(x.length for x in got)


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_in_few_sequences(seed):
    r = random.Random(seed)
    histogram = defaultdict(int)
    for _ in range(400):
        histogram[min(256, int(r.expovariate(1 / 60)) + 1)] += r.choice([1, 1, 50])
    patterns = packing.plan(dict(histogram), 256, 200)
    used = defaultdict(int)
    for pattern, times in patterns:
        assert sum(length * k for length, k in pattern.items()) <= 256
        for length, k in pattern.items():
            used[length] += k * times
    assert used == histogram
    assert sum(t for _, t in patterns) <= 1.01 * sum(a * b for a, b in histogram.items()) / 256 + 2


def test_cache_is_cleared_when_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_UNITS", 50)
    known = packing.WordIds(PATH)
    for text in [" ".join(f"w{chr(97 + i % 26)}{'ab'[k % 2] * k}" for i in range(40)) for k in range(8)]:
        raw = text.encode()
        ids, _ = known.ids(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == expected(text)
