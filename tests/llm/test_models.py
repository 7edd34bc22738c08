"""Toxicity, language-model scores and decontamination: held-out accuracy, exact parts, recall against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import pyarrow as pa

from boxwright.llm import boosting, bytesops, decontaminate, lm_score, toxicity


def vocabulary(seed, n=400):
    r = random.Random(seed)
    return ["".join(r.choice("aeioubdklmnrst") for _ in range(r.randrange(2, 9))) for _ in range(n)]


def test_isotonic_is_monotone_and_pools():
    f = boosting.fit_isotonic(np.array([0.0, 1.0, 2.0, 3.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0, 1.0]))
    x = np.linspace(-1, 4, 50)
    assert np.all(np.diff(f(x)) >= 0) and 0 <= f(x).min() and f(x).max() <= 1 and abs(f(np.array([1.5]))[0] - 0.5) < 1e-9


def test_trees_learn_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosting.fit_trees(x[:2000], y[:2000], 40, 3)
    assert ((model.logits(x[2000:]) > 0) == (y[2000:] > 0)).mean() > 0.97


def toxic_corpus(n=900):
    r, words, bad = random.Random(2), vocabulary(5), ["grobwort", "zankvolk", "idiot"]
    rows, labels = [], []
    for d in range(n):
        text = [r.choice(words) for _ in range(r.randrange(5, 120))]
        toxic = r.random() < 0.25
        if toxic:
            for _ in range(r.randrange(1, 4)):
                w = r.choice(bad)
                text.insert(r.randrange(len(text)), r.choice([w, w.upper(), w.replace("o", "0"), w + r.choice(["en", "st", "ung"])]))
        rows.append((d, " ".join(text)))
        labels.append((d, 1, int(toxic)))
    return rows + [(5000, None), (5001, ""), (5002, "Ä" * 9), (0, rows[0][1])], labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, predicted int").repartition(3)
    table = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, table).collect()
    assert len(got) == len(rows)
    truth = {d: t for d, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.keep_clean(docs, table).collect()}
    assert kept == {r.doc_id for r in got if not r.predicted}


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.limit(0), none).count() == 0


def lm_corpus():
    r = random.Random(6)
    rows = []
    for d in range(400):
        own = vocabulary(d % 3, 120)
        rows.append((d, " ".join(own[min(int(r.expovariate(0.05)), 119)] for _ in range(r.randrange(0, 90)))))
    return rows + [(900, None), (901, ""), (902, "New WORDS ünseen \x0b here")]


def test_lm_base_scores_are_exact_and_the_model_is_better(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 60)
    rows = lm_corpus()
    docs = spark.createDataFrame([(d, t, 0.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got = {r.doc_id: r for r in lm_score.lm_scores(docs).collect()}
    tokens = {d: (t or "").encode().lower().split() + [None] for d, t in rows}
    trains = {d: zlib.crc32(str(d).encode()) % 10 != 0 for d, _ in rows}
    c = Counter(w for d, t in tokens.items() if trains[d] for w in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not trains[d], len(t), sum(c[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_probabilities_sum_to_one(spark):
    """Brute force over every leaf: the classes' products sum to one after any history, and so do the words of each last class."""
    docs = spark.createDataFrame(lm_corpus()[:120], "doc_id long, text string")
    counts = lm_score.word_counts(docs)
    words = lm_score.frequent_words(counts)
    model = lm_score.train(docs, words)
    (_, _, w), *_ = bytesops.words_in(pa.array([b"some words here"]), lower=True)
    features = [f[-1:] for f in lm_score.history(lm_score.tokens(w))]
    codes, slot = np.arange(256).repeat(256), np.tile(np.arange(256), 256)
    total = np.zeros(len(codes))
    for d in lm_score.decisions(codes, slot, [f.repeat(len(codes)) for f in features], words.rows):
        total[d.token] += model.log_probabilities(d)[np.arange(len(d.token)), d.chosen]
    # words of a class of their own have one slot
    p = np.exp(total)
    assert math.isclose(p[(codes > lm_score.OWN) | (slot == 0)].sum(), 1, rel_tol=1e-4)
    seen = np.zeros(256 * 256)
    suffix = {int(h): int(s) for h, s, _ in counts.collect()}
    for h, count, o in zip(words.hashes, words.counts.tolist(), words.own.tolist(), strict=True):
        leaf = o * 256 if o >= 0 else suffix[int(h.view(np.int64))] * 256 + int(lm_score.slots(np.array([h]))[0])
        seen[leaf] += (count - lm_score.DISCOUNT) / words.leaf_total[leaf]
    assert np.allclose(seen + 10 ** words.unseen(), 1)


def test_words_that_begin_alike_are_found_and_chosen_classes_agree():
    r = np.random.default_rng(3)
    # many hashes with the same leading bits, in places up to the last
    hashes = np.unique(np.concatenate((r.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2), np.uint64((1 << 64) - 1) - np.arange(40, dtype=np.uint64), np.uint64(5 << 50) + np.arange(60, dtype=np.uint64))))
    n = np.ones(lm_score._CODES**2)
    words = lm_score.Words(hashes, np.ones(len(hashes), np.int64), np.full(len(hashes), -1), len(hashes), len(hashes), n, n, 1 << 14)
    asked = np.concatenate((hashes, hashes + np.uint64(1), hashes - np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)))
    place = {h: k for k, h in enumerate(hashes.tolist())}
    assert words.find(asked, words.begins()).tolist() == [place.get(h, -1) for h in asked.tolist()]
    model = lm_score.Model(words.shares(), r.normal(0, 1, (words.rows, lm_score.WIDTH)).astype(np.float32))
    codes = r.integers(0, lm_score._CODES, 300)
    features = [r.integers(0, 1 << 32, 300, np.uint32) for _ in range(6)]
    for d in lm_score.decisions(codes, codes[::-1], features, words.rows):
        assert np.allclose(model.log_chosen(d), model.log_probabilities(d)[np.arange(len(d.token)), d.chosen], atol=1e-4)


def test_lm_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm_score.lm_scores(docs).count() == 0


def edits_in(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        old, row = row, [0]
        for j, x in enumerate(item, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != c)))
        best = min(best, row[-1])
    return best


def test_best_distance_equals_dynamic_programming():
    r = random.Random(1)
    for _ in range(200):
        item = "".join(r.choice("abc é") for _ in range(r.randrange(1, 90)))
        text = "".join(r.choice("abc é") for _ in range(r.randrange(0, 120)))
        assert decontaminate.best_distance(item, text, 99) == edits_in(item, text)


def test_decontamination_recall_and_precision(spark):
    r, words = random.Random(3), vocabulary(9, 900)
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(15, 50)))) for k in range(30)] + [(100, None), (101, ""), (102, "too short"), (103, "the same words"), (103, "the same words")]
    rows, planted = [], set()
    for d in range(200):
        text = [r.choice(words) for _ in range(r.randrange(0, 150))]
        if d % 2:
            k = r.randrange(30)
            own = items[k][1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                own[r.randrange(len(own))] = r.choice(words)
            at = r.randrange(len(text) + 1)
            text[at:at] = own
            if edits_in(items[k][1], " ".join(text)) <= int(0.2 * len(items[k][1]) + 1e-9):
                planted.add((d, k))
        rows.append((d, " ".join(text).title() if d % 3 else "\n".join(text)))
    rows += [(900, None), (901, ""), (902, items[0][1] * 2), (1, rows[1][1])]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, similarity double").repartition(3)
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.contaminated(docs, bench).collect()}
    texts = {d: decontaminate.normalise(t) for d, t in rows}
    for (d, k), similarity in got.items():
        item = decontaminate.normalise(dict(items)[k])
        assert math.isclose(similarity, 1 - edits_in(item, texts[d]) / len(item)) and similarity >= 0.8
    found = sum(p in got for p in planted)
    assert found >= 0.95 * len(planted)
    verdicts = decontaminate.verdicts(docs, bench).collect()
    assert len(verdicts) == len(rows) and {v.doc_id for v in verdicts if v.contaminated} == {d for d, _ in got}
    kept = {x.doc_id for x in decontaminate.keep_clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in got}


def test_gradient_rounds_see_every_training_text(spark):
    r, words = random.Random(6), vocabulary(4, 60)
    docs = spark.createDataFrame([(d, " ".join(r.choice(words) for _ in range(20))) for d in range(80)], "doc_id long, text string")
    known = lm_score.frequent_words(lm_score.word_counts(docs))
    model = lm_score.Model(known.shares(), np.zeros((known.rows, lm_score.WIDTH), np.float32))
    seen = sum(lm_score.moments(docs, known, model, turn)[0] for turn in range(lm_score.ROUNDS))
    whole, expected = lm_score.moments(docs, known, model)
    assert np.allclose(seen, whole, atol=1e-3)
    # each choice is one observed and one expected
    assert np.allclose(whole.sum(axis=1), expected.sum(axis=1), atol=1e-2)


def found_in(items, texts):
    """{(text number, item id)} without Spark."""
    index = decontaminate.build([(k, decontaminate.normalise(t)) for k, t in items])
    column, out = pa.array([t.encode() for t in texts], pa.binary()), set()
    for at, _, w in bytesops.words_in(column, lower=True):
        out |= {(at + d, index.ids[k]) for d, k in decontaminate.matches(w, index)}
    return out


def test_short_items_are_found_at_every_offset():
    r, words = random.Random(5), vocabulary(21, 900)
    items = [(k, " ".join(r.choice(words) for _ in range(5 + k % 5))) for k in range(60)]
    texts, planted = [], set()
    for k, item in items:
        for offset in range(4):
            text = [r.choice(words) for _ in range(60)]
            text[20 + offset : 20 + offset] = item.split()
            planted.add((len(texts), k))
            texts.append("  ".join(text) if k % 3 else "\n".join(text))
    assert found_in(items, texts) == planted


def edited(r, item, rate):
    """About so many characters replaced, dropped or doubled with another."""
    out = []
    for c in item:
        out.append(c if r.random() >= rate else r.choice(["", r.choice("xyz "), c + r.choice("xyz ")]))
    return " ".join("".join(out).split())


@pytest.mark.parametrize("rate, least", [(0.05, 0.99), (0.1, 0.97), (0.15, 0.92)])
def test_recall_of_passages_with_edits_spread_over_characters(rate, least):
    """Against brute force: every planted passage at a similarity of 0.8 or more counts, items of 15 to 59 words."""
    r, words = random.Random(8), [w for w in vocabulary(33, 4000) if len(w) > 3]
    items = [(k, " ".join(r.choice(words) for _ in range(r.randrange(15, 60)))) for k in range(120)]
    texts, planted = [], set()
    for k, item in items:
        texts.append(" ".join(["vor é \u00a0", *r.sample(words, 20), edited(r, item, rate), *r.sample(words, 20)]))
        if edits_in(item, decontaminate.normalise(texts[-1])) <= 0.2 * len(item):
            planted.add((len(texts) - 1, k))
    assert len(planted) > 80
    found = found_in(items, texts)
    assert found <= planted and len(found) >= least * len(planted)


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.verdicts(docs, bench).first().contaminated is False
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f g")], bench.schema)).count() == 0
