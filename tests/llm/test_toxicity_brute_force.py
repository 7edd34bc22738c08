"""Features, lexicon, trees and calibration of the toxicity operator against plain definitions."""

import math
import random

import numpy as np
import pyarrow as pa

from boxwright.llm import boosting, bytesops, toxicity

TERMS = {"vile": 3.0, "scum": 4.5, "odd": 1.6}
BEGINNINGS = {"vile": 2.6, "wretc": 4.2}


def lexicon():
    whole = bytesops.hash_words(list(TERMS))
    begins = [bytesops.mix(bytesops.hash_words([b]) + np.uint64(toxicity.PREFIXES.index(len(b)) + 1))[0] for b in BEGINNINGS]
    hashes, odds = np.concatenate((whole, np.array(begins, np.uint64))), np.array([*TERMS.values(), *BEGINNINGS.values()])
    order = np.argsort(hashes)
    return toxicity.Lexicon(hashes[order], odds[order])


def plain_features(text):
    raw = text.encode()
    letter = lambda c: chr(c).isalpha() if c < 128 else True
    stands = toxicity.STANDS_FOR
    inner = [0 < i < len(raw) - 1 and c in stands and letter(raw[i - 1]) and letter(raw[i + 1]) for i, c in enumerate(raw)]
    runs, now = [], []
    for i, c in enumerate(raw):
        if letter(c) or inner[i]:
            now.append(i)
        elif now:
            runs.append(now)
            now = []
    runs += [now] if now else []
    words = [bytes(stands[raw[i]] if inner[i] else raw[i] for i in run).decode().lower() for run in runs]
    whole = [TERMS.get(w, 0.0) for w in words]
    begins = [max([0.0, *(v for b, v in BEGINNINGS.items() if len(w.encode()) > len(b) and w.startswith(b))]) for w in words]
    best = [max(p) for p in zip(whole, begins, strict=True)]
    per, size = max(len(words), 1), max(len(raw), 1)
    out = []
    for odds in (whole, begins):
        for tier in toxicity.TIERS:
            n = sum(o >= tier for o in odds)
            out += [n, n / per]
    out += [max([0.0, *best]), sum(best) / per]
    second = [w in toxicity.SECOND_PERSON for w in words]
    out.append(sum(b >= toxicity.TIERS[1] and any(second[max(i - toxicity.NEAR, 0) : i + toxicity.NEAR + 1]) for i, b in enumerate(best)))
    out.append(sum(second) / per)
    capital = lambda c: 65 <= c <= 90
    out.append(sum(map(capital, raw)) / size)
    out.append(sum(len(run) >= 3 and sum(capital(raw[i]) for i in run) >= 0.8 * len(run) for run in runs) / per)
    out.append(sum(c in b"!?" for c in raw) / size)
    out.append(sum(32 < c < 48 or 57 < c < 65 for c in raw) / size)
    out.append(sum(c in b"#$%&" for c in raw) / size)
    out.append(sum(inner) / per)
    return [*out, math.log1p(len(words)), size / per]


def test_features_equal_their_definition():
    r = random.Random(11)
    parts = ["you", "Vile", "v1le", "SCUM", "5cum", "odd", "wretches", "wretc", "tú", "ÜBER", "a0", "0b", "!?", "#$%", "good", "day.", "x" * 300]
    texts = ["", "   ", "a0", "b", "0c", "SCUM", *(r.choice([" ", "\n"]).join(r.choice(parts) for _ in range(r.randrange(1, 40))) for _ in range(60))]
    (_, _, w), = bytesops.words_in(pa.array([t.encode() for t in texts], pa.binary()))
    np.testing.assert_allclose(toxicity.features(w, lexicon()), [plain_features(t) for t in texts], atol=1e-12)
    # a text's features do not depend on its neighbours
    for t in texts[:12]:
        (_, _, alone), = bytesops.words_in(pa.array([t.encode()], pa.binary()))
        np.testing.assert_allclose(toxicity.features(alone, lexicon())[0], plain_features(t), atol=1e-12)


def test_lexicon_keeps_every_telling_term(spark):
    r = random.Random(12)
    words = [f"neutral{i}" for i in range(40)]
    # more telling terms than any list would hold: each in two toxic texts of two folds
    rows, labels = [], []
    for i in range(300):
        toxic = int(i % 3 == 0)
        rows.append((i, " ".join([*r.sample(words, 8), *(f"zz{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}q" for k in range(i // 6 * 20, i // 6 * 20 + 20) if toxic)])))
        labels.append((i, toxic))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    import zlib

    seen = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = [sum(1 for _, y in seen if y == k) for k in (0, 1)]
    expected = {}
    for word in {x for t, _ in seen for x in t.split()}:
        if word.isalpha():
            c = [sum(1 for t, y in seen if y == k and word in t.split()) for k in (0, 1)]
            odds = math.log((c[1] + 0.5) / (texts[1] + 1)) - math.log((c[0] + 0.5) / (texts[0] + 1))
            if c[1] >= 2 and odds - 1 / math.sqrt(c[1]) >= toxicity.TIERS[0]:
                expected[word] = odds
    got = model.lexicon.look_up(bytesops.hash_words(list(expected)))
    assert expected
    np.testing.assert_allclose(got, list(expected.values()), atol=1e-9)


def test_one_split_is_the_best_of_all():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 12, (300, 4)).astype(float), r.integers(0, 2, 300).astype(float)
    y[x[:, 2] > 7] = 1
    model = boosting.fit_trees(x, y, rounds=1, depth=1)
    p = 1 / (1 + np.exp(-model.base))
    g, h = y - p, np.full(len(y), p * (1 - p))
    worth = lambda own: g[own].sum() ** 2 / (h[own].sum() + 2.0)
    gains = {(f, c): worth(x[:, f] <= c) + worth(x[:, f] > c) for f in range(4) for c in range(11)}
    f, c = model.features[0][0], model.cuts[0][0]
    assert gains[f, c] == max(gains.values())
    for leaf, own in enumerate((x[:, f] <= c, x[:, f] > c)):
        assert abs(model.leaves[0][leaf] - 0.15 * g[own].sum() / (h[own].sum() + 2.0)) < 1e-12


def test_isotonic_equals_the_min_max_form():
    r = np.random.default_rng(4)
    logit = r.integers(-8, 9, 200) / 2.0
    y = (r.random(200) < 1 / (1 + np.exp(-logit))).astype(float)
    at = np.unique(logit)
    own = [y[logit == a] for a in at]
    mean = lambda j, k: np.concatenate(own[j : k + 1]).mean()
    level = [max(min(mean(j, k) for k in range(i, len(at))) for j in range(i + 1)) for i in range(len(at))]
    rows = {v: sum(len(own[i]) for i in range(len(at)) if abs(level[i] - v) < 1e-12) for v in level}
    expected = np.maximum.accumulate([(v * rows[v] + 0.5) / (rows[v] + 1) for v in level])
    np.testing.assert_allclose(boosting.fit_isotonic(logit, y)(at), expected, atol=1e-9)
