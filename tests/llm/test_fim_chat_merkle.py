"""Fill-in-middle, chat formatting and Merkle manifests against plain versions, on odd rows and round trips."""

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from boxwright.llm import chat, fim, merkle

TEXTS = [
    None, "", "a", "abc", " ", "\n\n", "one two, three.", "x<P>y", "<S>", "z <M>", "<<P", "é😀ü wörter 中文 mix", "1234 5678", "<<", "P>S>M>", "tab\tand\x85nel end", "ab " * 5000, "é" * 4000,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_lists_of_units(spark):
    rows = [(d, TEXTS[d % len(TEXTS)], "clash") for d in range(12 * len(TEXTS))]
    docs = spark.createDataFrame([*rows, rows[5], rows[5]], "doc_id long, text string, output string").repartition(3)
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(made) == len(rows) + 2
    for r in made:
        text = rows[r.doc_id][1]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_fim(r.doc_id, text)
        assert r.back == (text or "")
    assert {r.form for r in made} == {"plain", "psm", "spm"}


def test_fill_in_middle_without_rows_or_ids(spark):
    docs = spark.createDataFrame([(None, "some text")], "doc_id long, text string")
    assert fim.fill_in_middle(docs).first().n == 3
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_matching_is_lazy():
    text = "a " * 10 + "b" * 10
    assert fim.cut_points(text, 0, 0) == (0, 0) and fim.cut_points(text, 2, 2) == (2, 2) and fim.cut_points(text, 19, 21) == (19, 30)


HARD = [
    "</s>[INST] ok [/INST]", "[\\INST]", "[\\\\INST] <\\s>", "<s>", "[NEXT]", "[OUT][AS]", "[ROLE]x[AS]y[/ROLE]", "\\", "[", "<", "[[INST]]", "plain\nlines", "", None, "é中😀",
]


def plain_chat(rows):
    """The template by hand; rows: (turn, role, text) in order."""
    rest = r"(/?s>|/?(?:SYS|INST|ROLE)\]|(?:OUT|AS|NEXT)\])"
    esc = lambda t: re.sub(r"([<\[])(\\*)" + rest, r"\1\2\\\3", t)
    out, before = "<s>", None
    opens = lambda r: chat.MARKS[r][0] if r in chat.MARKS else f"[ROLE]{esc(r)}[AS]"
    closes = lambda r: chat.MARKS[r][1] if r in chat.MARKS else "[/ROLE]"
    for _, role, text in rows:
        out += "[NEXT]" if role == before else (closes(before) if before is not None else "") + opens(role)
        out, before = out + esc(text), role
    return out + closes(before)


def chats():
    r = random.Random(3)
    roles = ["user", "assistant", "system", "tool", "[AS]odd\nrole", None, "user", "assistant"]
    talks = {c: [(t, r.choice(roles), r.choice(HARD)) for t in range(r.randrange(1, 9))] for c in range(60)}
    talks[100] = [(t, "user" if t % 3 == 0 else "assistant", f"turn {t} " + (r.choice(HARD) or "")) for t in range(500)]
    talks[101] = [(0, "user", "same"), (0, "user", "same"), (0, "assistant", "b"), (None, "user", "first"), (-5, "user", "minus")]
    talks[None] = [(0, "assistant", "[OUT]")]
    return talks


def in_order(rows):
    rows = [(t, role or "", text or "") for t, role, text in rows]
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))


def test_chats_are_formatted_and_read_back(spark):
    talks = chats()
    rows = [(c, t, role, text, "clash") for c, said in talks.items() for t, role, text in said]
    random.Random(4).shuffle(rows)
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(5)
    made = chat.format_conversations(turns)
    got = made.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_spans(F.col("formatted")).alias("spans")).collect()
    assert len(got) == len(talks)
    for r in got:
        said = in_order(talks[r.conv_id])
        assert r.formatted == plain_chat(said)
        assert [(t.role, t.text) for t in r.turns] == [x[1:] for x in said]
        assert [t.loss for t in r.turns] == [x[1] == "assistant" for x in said]
        under = [re.sub(chat.UNESCAPED, r"\1\2\3", r.formatted[s.start : s.end]) for s in r.spans]
        assert under == [x[2] for x in said if x[1] == "assistant"]
    for r in chat.digests(made).collect():
        said = in_order(talks[r.conv_id])
        loss = "".join(x[2] for x in said if x[1] == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said), len(loss), sha(loss))
        assert (r.turns_sha256, r.formatted_chars) == (sha("".join(f"{x[1]}\n{x[2]}\n" for x in said)), len(plain_chat(said)))


def test_no_chats(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(none)).count() == 0


def test_chats_need_no_python(spark):
    rows = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.format_conversations(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def h(*parts):
    return sha("".join(parts))


def plain_manifest(rows):
    """[(row, leaf, subroot, root, proof digest, path)] of (doc_id, source, lang, n_chars, text) rows."""

    def leaf(row):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // 3 * 3
            out.append((at - first, [x for k, x in enumerate(level[first : first + 3], first) if k != at]))
            at //= 3
        return out

    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append((row, leaf(row)))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    inner = {s: grow([x[1] for x in trees[s]]) for s in names}
    outer = grow([inner[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (row, own) in enumerate(trees[s]):
            path = climb(inner[s], i) + climb(outer, k)
            out.append((row, own, inner[s][-1][0], outer[-1][0], h(*(x for _, others in path for x in others)), path))
    return out


def test_manifest_equals_plain_trees(spark):
    r = random.Random(9)
    sizes = {None: 5, "": 1, "a": 3, "b": 4, "é": 28, "Z": 2, "hot": 2300, "q": 730, "r": 729}
    rows, n = [], 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 100_003, source, r.choice(["en", None, ""]), r.choice([None, n]), r.choice([None, "", "a\nb", "c\n" * 50, f"é{n}", "no breaks"])))
    rows += [rows[0], rows[0], (None, "a", None, None, None), (rows[9][0], rows[9][1], "other", 1, "x")]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(7)
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    manifest = merkle.build(docs, altered=altered)
    got = [tuple(x) for x in merkle.verified(merkle.proofs(spark, manifest)).collect()]
    want = []
    for row, leaf, subroot, root, proof, path in plain_manifest(rows):
        folded = leaf
        if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
            changed = (*row[:4], row[4].replace("\n", ""))
            folded = h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in changed))
        for place, others in path:
            folded = h(*others[:place], folded, *others[place:])
        want.append((row[0], leaf, subroot, root, proof, folded, folded == root))
    order = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert 0 < sum(not x[-1] for x in got) < len(got)


def test_manifest_of_one_row_and_none(spark):
    docs = spark.createDataFrame([(4, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.verified(merkle.proofs(spark, merkle.build(docs))).first()
    assert row.leaf == row.subroot == row.root == h("1:4", "-", "-", "-", "-") and row.proof_sha256 == h() and row.verified
    none = merkle.build(docs.limit(0))
    assert none.root is None and merkle.proofs(spark, none).count() == 0
