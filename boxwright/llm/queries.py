"""The thin queries ``opN_<name>`` over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxwright.llm.store import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.line_dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from boxwright.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.decontaminate import verdicts

    return verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.warc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.fim import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.chat import digests, format_conversations

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], turns.schema)
    return digests(format_conversations(turns.union(more)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from boxwright.llm.merkle import build, proofs, verified

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    manifest = build(table(spark, sf_dir, "documents"), altered=tampered)
    return verified(proofs(spark, manifest))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: Records of equal payloads from 1000 bytes on: the largest page_id answers, the others revisit it.
_WARC_SQL = """WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS r FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest, CASE WHEN r <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r <> d.page_id THEN r END AS refers_to
FROM d LEFT JOIN m ON m.h = d.h AND d.n >= 1000"""


#: Units by a regular expression; ranks and forms from the digest of the id.
_FIM_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM d),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 AS plain FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM n),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf, CASE WHEN plain THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""

#: The round trip gives the turns as they are; the formatted length counts marks, escapes and blocks.
_CHAT_SQL = r"""WITH m AS (SELECT * FROM (VALUES ('system', 5, 6), ('user', 6, 7), ('assistant', 5, 4)) m(role, o, c)),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT t.*, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|(?:OUT|AS|NEXT)\])', '\1\2\\\3', 'g')) AS k,
coalesce(o, length(regexp_replace(t.role, '([<\[])(\\*)(/?s>|/?(?:SYS|INST|ROLE)\]|(?:OUT|AS|NEXT)\])', '\1\2\\\3', 'g')) + 10) AS o, coalesce(c, 7) AS c,
lag(t.role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, t.role, text) AS before FROM t LEFT JOIN m ON m.role = t.role)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(3 + sum(k + CASE WHEN before = role THEN 6 ELSE o + c END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

#: CRC-32 of a decimal number: a character at a time, eight shifts each.
_CRC_SQL = """xor(list_reduce(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: ascii(CAST(doc_id AS VARCHAR)[i])),
lambda c, b: list_reduce(range(8), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

#: Levels by recursion, then every leaf climbs them with its siblings.
_MERKLE_SQL = f"""WITH RECURSIVE f AS (SELECT doc_id, source, text, coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
|| coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars, '-') AS head FROM documents),
h AS (SELECT doc_id, coalesce('=' || source, '') AS tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), ''), '-')) AS changed FROM f),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM h),
node AS (SELECT tree, 0 AS level, pos, n, leaf AS hash FROM leaf
UNION ALL SELECT tree, level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY pos)) FROM node WHERE n > 1 GROUP BY tree, level, pos // 3),
top AS (SELECT tree, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM node WHERE n = 1),
upper AS (SELECT 0 AS level, pos, n, subroot AS hash FROM top
UNION ALL SELECT level + 1, pos // 3, any_value((n + 2) // 3), sha256(string_agg(hash, '' ORDER BY pos)) FROM upper WHERE n > 1 GROUP BY level, pos // 3),
step AS (SELECT tree, level, pos, coalesce(string_agg(hash, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
coalesce(string_agg(hash, '') OVER (PARTITION BY tree, level, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM (SELECT * FROM node WHERE n > 1 UNION ALL SELECT NULL, level, pos, n, hash FROM upper WHERE n > 1)),
climb AS (SELECT tree, pos AS id, 0 AS level, pos, '' AS proof, CASE WHEN crc32 % 2 = 0 THEN changed ELSE leaf END AS hash FROM (SELECT *, {_CRC_SQL} AS crc32 FROM leaf)
UNION ALL SELECT c.tree, id, c.level + 1, c.pos // 3, proof || l || r, sha256(l || c.hash || r) FROM climb c JOIN step s ON s.tree = c.tree AND s.level = c.level AND s.pos = c.pos),
inside AS (SELECT tree, id, arg_max(proof, level) AS proof, arg_max(hash, level) AS hash FROM climb GROUP BY tree, id),
beyond AS (SELECT i.tree, id, 0 AS level, t.pos, proof, hash FROM inside i JOIN top t ON t.tree = i.tree
UNION ALL SELECT b.tree, id, b.level + 1, b.pos // 3, proof || l || r, sha256(l || b.hash || r) FROM beyond b JOIN step s ON s.tree IS NULL AND s.level = b.level AND s.pos = b.pos),
done AS (SELECT tree, id, arg_max(proof, level) AS proof, arg_max(hash, level) AS folded FROM beyond GROUP BY tree, id)
SELECT doc_id, leaf, subroot, u.hash AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = u.hash AS verified
FROM leaf a JOIN done d ON d.tree = a.tree AND d.id = a.pos JOIN top t ON t.tree = a.tree JOIN upper u ON u.n = 1"""


def oracle_sql() -> dict[str, str]:
    """Archives, fill-in-middle, chats and manifests are within SQL: the others rest on XXH64, edit distance, tokenizers or trained models."""
    return {"op8_warc": _WARC_SQL, "op11_fill_in_middle": _FIM_SQL, "op12_chat_format": _CHAT_SQL, "op13_merkle_manifest": _MERKLE_SQL}
