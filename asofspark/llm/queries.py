"""The registered queries of this subpackage, bound to the test tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofspark.llm import anchortree, bpe, decontaminate, htmltree, impacts, linededup, periodic, quality, runindex, shards, simhash, toxicity, urlrules
from asofspark.llm.common import table


def byte_codec(spark: SparkSession) -> bpe.Codec:
    return bpe.Codec(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.report(table(spark, sf_dir, "documents")).drop("starts", "ends")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), byte_codec(spark))


def op3_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


SHARDS = 24


def op4_slot_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), SHARDS, uuid.uuid4().hex)


# bytes of a text, folded with the 256 remainders of the checksum's polynomial
_CRC32_SQL = """list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]))"""

OP4_SQL = f"""
WITH RECURSIVE bits(k, v, i) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM bits WHERE i < 8),
crc AS (SELECT list(v ORDER BY k) AS crc_table FROM bits WHERE i = 8),
records AS (
  SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 8 AS BIGINT) AS size,
    CAST(xor({_CRC32_SQL}, 4294967295) AS BIGINT) AS text_crc32,
    CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) AS INT) AS vslot
  FROM documents, crc),
usage AS (SELECT vslot, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS n FROM records GROUP BY vslot),
queue AS (SELECT vslot, bytes, row_number() OVER (ORDER BY bytes DESC, vslot) AS i FROM usage),
greedy(i, vslot, shard, loads) AS (
  SELECT 0::BIGINT, NULL::INT, NULL::INT, list_transform(range({SHARDS}), lambda x: 0::BIGINT)
  UNION ALL
  SELECT q.i, q.vslot, CAST(list_position(loads, list_min(loads)) - 1 AS INT),
    list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + q.bytes ELSE x END)
  FROM greedy g JOIN queue q ON q.i = g.i + 1),
starts AS (
  SELECT vslot, shard, coalesce(sum(n) OVER (PARTITION BY shard ORDER BY vslot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM greedy JOIN usage USING (vslot))
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(start + row_number() OVER (PARTITION BY vslot ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INT) AS grown_shard
FROM records JOIN starts USING (vslot)"""


# fixed values: the rules of the contract
URL_RULES = [
    urlrules.Rule("allow", "com", "/"),
    urlrules.Rule("block", "example.com", "/en/"),
    urlrules.Rule("allow", "www.example.com", "/en/"),
    urlrules.Rule("block", "net", "/es/"),
    urlrules.Rule("block", "net", "/fr/"),
]


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


OP5_SQL = f"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, rhost, rpath) AS (VALUES {", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)}),
fits AS (
  SELECT page_id, rhost || rpath AS rule, verdict FROM urls, rules
  WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN best USING (page_id)"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("kept_text")


_CHARS = "length(regexp_replace(line, '{}', '', 'g'))"
_PHRASES_SQL = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)

OP7_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
windows AS (SELECT uid, i, list_slice(ws, i, i + 7) AS w FROM d, unnest(range(1, len(ws) - 6)) u(i)),
twice AS (SELECT uid, w FROM windows GROUP BY uid, w HAVING count(*) > 1),
hit AS (
  SELECT uid, count(DISTINCT p) AS n FROM windows JOIN twice USING (uid, w), unnest(range(i, i + 8)) u(p) GROUP BY uid),
placed AS (SELECT uid, i, lines[i] AS line, CASE WHEN i > 1 THEN lines[i - 1] END AS before, lines[i + 1] AS after FROM d, unnest(range(1, len(lines) + 1)) u(i)),
learned AS (
  SELECT line FROM (SELECT DISTINCT line, before, after FROM placed WHERE length(line) <= {quality.LEARNED_CHARS})
  GROUP BY line HAVING count(*) >= greatest({quality.LEAST_CONTEXTS}, (SELECT ceil(count(*) / {quality.DOCUMENTS_A_CONTEXT}e0) FROM documents))),
firsts AS (SELECT uid, line, min(i) AS i FROM placed GROUP BY uid, line),
measured AS (
  SELECT uid, line, row_number() OVER (PARTITION BY uid ORDER BY i) AS k, length(line) AS chars, {_CHARS.format(chr(92) + "P{L}+")} AS letters, {_CHARS.format(chr(92) + "P{Lu}+")} AS capitals,
    length(regexp_replace(line, '[^#*$%&|<>{{}}\\[\\]=_~^»›•·]+', '', 'g')) AS symbols,
    regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS lw,
    regexp_matches(line, '[.!?…:;"''”’»)\\]。！？]\\s*$') AS closed, {_PHRASES_SQL} AS phrase
  FROM firsts),
shorts AS (SELECT uid, k, k - row_number() OVER (PARTITION BY uid ORDER BY k) AS island FROM measured WHERE len(lw) <= {quality.NAV_WORDS} AND NOT closed),
nav AS (SELECT uid, unnest(list(k)) AS k FROM shorts GROUP BY uid, island HAVING count(*) >= {quality.NAV_RUN}),
good AS (
  SELECT uid, sum(chars) AS kept_chars FROM measured
  WHERE (chars < {quality.LONG_LINE} OR closed) AND symbols * 20 <= chars AND letters * 2 >= chars AND (letters < 20 OR capitals * 2 <= letters)
    AND (len(lw) < 12 OR len(list_distinct(lw)) * 5 >= least(len(lw), 60) * 2) AND NOT phrase
    AND NOT EXISTS (SELECT 1 FROM nav WHERE nav.uid = measured.uid AND nav.k = measured.k) AND line NOT IN (SELECT line FROM learned)
  GROUP BY uid),
base AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(kept_chars, 0) >= {quality.MIN_KEPT_SHARE} * coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) AS enough
  FROM d LEFT JOIN hit USING (uid) LEFT JOIN good USING (uid))
SELECT * EXCLUDE (enough), n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AND enough AS kept
FROM base"""


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.hit_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return htmltree.extract_pages(pages, htmltree.train(pages))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

OP9_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS_SQL} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS ws FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(ws), 13) AS span, list_slice(ws, i, i + 12) AS w
  FROM b, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) u(i) WHERE len(ws) > 0),
dw AS (
  SELECT uid, i, s.span, list_slice(ws, i, i + s.span - 1) AS w
  FROM d, (SELECT DISTINCT span FROM iw) s, unnest(range(1, len(ws) - s.span + 2)) u(i)),
m AS (SELECT uid, i, dw.span, item_id FROM dw JOIN iw ON dw.span = iw.span AND dw.w = iw.w),
hits AS (SELECT uid, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + span)) u(p) GROUP BY uid),
ids AS (
  SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (uid) LEFT JOIN ids USING (uid)"""


def op11_anchor_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh label is moved on by one, so that near rows of other labels exist."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return anchortree.hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def _vectors_sql(scale: int) -> str:
    return f"""
vectors AS (
  SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""


_SCORE_SQL = "CAST(list_sum(list_transform(range(1, 1 + least(len(q.v), len(x.v))), lambda i: q.v[i] * x.v[i])) AS BIGINT)"

OP11_SQL = f"""
WITH {_vectors_sql(256).strip()},
rows AS (SELECT uid, vec_id, v, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label FROM vectors WHERE label IS NOT NULL),
pairs AS (
  SELECT q.uid AS anchor, q.vec_id AS anchor_id, q.label = x.label AS same, x.uid, x.vec_id, {_SCORE_SQL} AS score
  FROM rows q JOIN rows x ON q.uid <> x.uid WHERE q.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, uid, vec_id AS positive_id, score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
mined AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id) AS INT) AS rank
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 10"""


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


OP12_SQL = f"""
WITH {_vectors_sql(64).strip()},
scored AS (
  SELECT q.uid, q.vec_id AS query_id, x.vec_id, {_SCORE_SQL} AS score FROM vectors q JOIN vectors x ON q.uid <> x.uid WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) <= 20"""


def _planted(words: Column, h: Column) -> Column:
    """Of every tenth checksum, the words from a on repeat with period p; the other texts as they are."""
    g = F.floor(h / 10)

    def repeated(ws: Column) -> Column:
        n = F.size(ws).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(ws, F.when(i >= a, a + (i - a) % p).otherwise(i))), " ")

    return F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, repeated(ws)))[0]


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = docs.withColumn("text", F.when(h % 10 == 0, _planted(words, h)).otherwise(F.col("text")))
    found = periodic.with_runs(docs, ["doc_id"])
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("n"), r.start.alias("start"), r.period.alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.n div best.period").alias("exponent_milli"),
        F.sha2(told, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_run_index": op1_run_index,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_line_winnowing": op3_line_winnowing,
    "op4_slot_shards": op4_slot_shards,
    "op5_url_rules": op5_url_rules,
    "op6_simhash": op6_simhash,
    "op7_line_quality": op7_line_quality,
    "op8_ftrl_toxicity": op8_ftrl_toxicity,
    "op9_prefix_decontamination": op9_prefix_decontamination,
    "op10_tree_extraction": op10_tree_extraction,
    "op11_anchor_tree": op11_anchor_tree,
    "op12_impact_search": op12_impact_search,
    "op13_lyndon_runs": op13_lyndon_runs,
}

ORACLES: dict[str, str] = {
    "op4_slot_shards": OP4_SQL,
    "op5_url_rules": OP5_SQL,
    "op7_line_quality": OP7_SQL,
    "op9_prefix_decontamination": OP9_SQL,
    "op11_anchor_tree": OP11_SQL,
    "op12_impact_search": OP12_SQL,
}
