"""One query for each corpus operator, with its production parameters, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, conversations, decontaminate, hard_negatives, language, quality_model, quality_rules, sharding, simhash, suffix_dedup, token_files, url_rules, warc
from tramline.llm.shared import shared_dir, utf8_size, written

#: Fixed rules of the query: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
SHARDS = 24
WARC_BYTES_A_SHARD = 64 << 20
VOCABULARY = "byte_bpe_50k.tiktoken"
WORD_VOCABULARY, END_ID = "word_bpe_49k.json", 2


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    shared_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def _digest(column) -> Column:
    return F.sha2(column, 256)


def held_out(id_column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = url_rules.build_rules(url_rules.rules_frame(spark, URL_RULES))
    return url_rules.apply_rules(_table(spark, sf_dir, "pages", "page_id", "url"), folder, "page_id", "url")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    total = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    folder = warc.write_archive(pages, max(12, -(-total // WARC_BYTES_A_SHARD)))
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = written(quality_rules.ledger(_table(spark, sf_dir, "documents", "doc_id", "text")), "rule-ledger")
    judged = quality_rules.judge(quality_rules.judge(entries, quality_rules.BASE, as_col="passed"), quality_rules.STRICT)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("passed")).alias("base_failed"), "kept")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match(_table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        _digest(F.array_join("items", ",").cast("binary")).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vocabulary()
    coded = bpe.encode(_table(spark, sf_dir, "documents", "doc_id", "text"), v, with_bytes=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _digest(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("ids_sha256"),
        _digest(F.col("bytes")).alias("decoded_sha256"),
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    rows = docs.select("doc_id", (utf8_size(F.col("text")) + 8).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(rows, SHARDS, "doc_id", "size")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), _digest(F.col("kept")).alias("kept_sha256"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = written(quality_model.feature_table(_table(spark, sf_dir, "documents", "doc_id", "text")), "features")
    labels = _table(spark, sf_dir, "labels", "doc_id", "quality").filter(~held_out(F.col("doc_id")))
    model = quality_model.train(table, labels, "doc_id", "quality")
    scored = quality_model.score(table, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language.train(docs.filter(~held_out(F.col("doc_id"))))
    named = language.identify(docs, model)
    return named.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tokenizer = token_files.WordTokenizer(public_tokenizers.path(WORD_VOCABULARY), END_ID)
    return token_files.read_files(spark, token_files.write_files(_table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer))


def damaged(talks: DataFrame) -> DataFrame:
    """The contract's damage: some rows dropped, emptied, cut, repeated or given to the user, by a checksum of their place; nulls are one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    rows = talks.filter(hit != 0)
    return rows.select("conv_id", "turn", F.when(hit == 4, "user").otherwise(some("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(hit == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversations.repair(damaged(talks), talks)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("id") % 100 == 0, "vec_id", "embedding", "label")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_rules, op2_warc, op3_quality_rules, op4_decontaminate, op5_bpe, op6_sharding, op7_suffix_dedup, op8_simhash, op9_quality_model, op10_language, op11_token_files, op12_conversation_repair, op13_hard_negatives)}


OP1_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM split, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT s.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM split s LEFT JOIN fits USING (page_id)
"""

OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

OP3_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \t-\r]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, i + k AS at FROM g JOIN twice USING (doc_id, gram), (VALUES (0), (1), (2)) AS o(k)),
rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^ \t-\r]')))::BIGINT AS n_lines,
  (len(list_filter(ls, lambda x: regexp_matches(x, '[^ \t-\r]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^ \t-\r]')))))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS caps
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * caps > 4 * word_chars) AS kept
FROM m
"""

OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, list_slice(ws, i, i + least(13, len(ws)) - 1) AS win FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
pos AS (SELECT doc_id, i, n, list_slice(ws, i, i + n - 1) AS win FROM d, (SELECT DISTINCT n FROM win) AS lens, unnest(range(1, len(ws) - n + 2)) AS u(i)),
occ AS (SELECT doc_id, i, pos.n, item_id FROM pos JOIN win USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, unnest(range(0, n)) AS o(k) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_STEPS = ", ".join(["-1"] * 8)
OP12_SQL = f"""
WITH RECURSIVE r AS (SELECT coalesce(conv_id::VARCHAR, '') AS k, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(place, ''), lambda c: [ascii(c)::BIGINT, {_STEPS}]))),
  lambda x, b: CASE WHEN b >= 0 THEN xor(x, b) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295) % 20 AS hit FROM r),
d AS (SELECT k, turn, CASE hit WHEN 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, n
  FROM h, (VALUES (0), (1)) AS c(n) WHERE hit <> 0 AND (n = 0 OR hit = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, n) AS i, row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, n) AS nth, left(role, 1) AS ini FROM d),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(regexp_replace(text, '[ \t-\r]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  lag(ini) OVER (PARTITION BY k ORDER BY i) || ini AS pair, i > 1 AS paired FROM o),
e AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 3 ELSE 0 END AS x FROM f),
walk AS (SELECT k, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': ''}} AS s0, {{'c': 1000000000::BIGINT, 'a': ''}} AS s1, {{'c': 3::BIGINT, 'a': 'I'}} AS s2, {{'c': 6::BIGINT, 'a': 'II'}} AS s3 FROM (SELECT DISTINCT k FROM e)
  UNION ALL SELECT k, i, t0, t1, c2, list_min([t3, {{'c': c2.c + 3, 'a': c2.a || 'I'}}]) FROM (
    SELECT *, list_min([t2, {{'c': t0.c + 3, 'a': t0.a || 'I'}}, {{'c': t1.c + 3, 'a': t1.a || 'I'}}, {{'c': t3.c + 3, 'a': t3.a || 'I'}}]) AS c2 FROM (
      SELECT e.k, e.i, {{'c': s0.c + 4, 'a': s0.a || 'D'}} AS t0,
        list_min([{{'c': s1.c + 4, 'a': s1.a || 'D'}}, {{'c': s0.c + x + CASE ini WHEN 's' THEN 0 ELSE 1000000000 END, 'a': s0.a || 'K'}}]) AS t1,
        list_min(list_concat([{{'c': s2.c + 4, 'a': s2.a || 'D'}}], flatten(list_transform([s0, s1, s3], lambda q: [{{'c': q.c + x + CASE ini WHEN 'u' THEN 0 ELSE 1000000000 END, 'a': q.a || 'K'}}, {{'c': q.c + x + 3, 'a': q.a || 'R'}}])))) AS t2,
        list_min([{{'c': s3.c + 4, 'a': s3.a || 'D'}}, {{'c': s2.c + x + CASE ini WHEN 'a' THEN 0 ELSE 1000000000 END, 'a': s2.a || 'K'}}, {{'c': s2.c + x + 3, 'a': s2.a || 'R'}}]) AS t3
      FROM walk JOIN e ON e.k = walk.k AND e.i = walk.i + 1) AS y) AS z),
best AS (SELECT k, list_min([arg_max(s0, i), arg_max(s3, i)]) AS b FROM walk GROUP BY k),
l AS (SELECT k, p, b.a[p] AS letter, sum(CASE WHEN b.a[p] <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY p) AS i FROM best, unnest(range(1, length(b.a) + 1)) AS u(p)),
kept AS (SELECT l.k, p, letter, CASE WHEN letter = 'I' THEN '' ELSE text END AS text, role, ini, row_number() OVER (PARTITION BY l.k ORDER BY p) - 1 AS seq FROM l LEFT JOIN e ON e.k = l.k AND e.i = l.i WHERE letter <> 'D'),
told AS (SELECT *, max(CASE WHEN seq = 0 AND letter = 'K' AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS led FROM kept),
said AS (SELECT k, string_agg(CASE WHEN letter = 'K' THEN role WHEN (seq - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS lines FROM told GROUP BY k),
n AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (paired AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT k, conv_id FROM r) AS c LEFT JOIN n USING (k) LEFT JOIN best USING (k) LEFT JOIN said USING (k)
"""

OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) AS x WHERE k <= 5),
n AS (SELECT anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT * FROM n WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_rules": OP1_SQL, "op2_warc": OP2_SQL, "op3_quality_rules": OP3_SQL, "op4_decontaminate": OP4_SQL, "op12_conversation_repair": OP12_SQL, "op13_hard_negatives": OP13_SQL}
