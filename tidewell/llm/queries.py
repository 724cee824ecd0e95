"""One registered query for each corpus operator, applied to its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import chat, hamming, hard_negatives, langid, matroska, mixing, ngram_join, packing, periodic, pii_crf, pu_quality, simhash, toxicity
from tidewell.llm.common import WORD, checkpointed, crc_fold, documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) BETWEEN 1 AND 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS gram FROM w),
n AS (SELECT w.doc_id, count(gram) AS n FROM w LEFT JOIN g USING (doc_id) GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id GROUP BY 1, 2, na.n, nb.n HAVING count(*) >= 0.8 * (na.n + nb.n - count(*)) - 1e-9),
reach(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.root),
class AS (SELECT doc_id, min(root) AS class_id FROM reach GROUP BY 1),
sets AS (SELECT doc_id, md5(string_agg(gram, chr(10) ORDER BY gram)) AS h FROM g GROUP BY 1),
copies AS (SELECT h, min(doc_id) AS copy_id FROM sets GROUP BY 1)
SELECT n.doc_id, class_id, coalesce(copy_id, n.doc_id) AS copy_id, (SELECT count(*) FROM links WHERE u = n.doc_id) AS n_links, n.n AS n_grams
FROM n JOIN class USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN copies USING (h)
"""


def op2_mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 8))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source),
fill AS (
  SELECT 0 AS step, (SELECT 1.5 * sum(source_size) FROM s) AS spare, list({'source': source, 'size': source_size, 'w': w, 'full': false}) AS items FROM s
  UNION ALL
  SELECT step + 1, spare - list_sum(list_transform(list_filter(items, lambda i: NOT i.full AND spare * i.w / open_w > 2 * i.size), lambda i: 2 * i.size)),
    list_transform(items, lambda i: {'source': i.source, 'size': i.size, 'w': i.w, 'full': i.full OR spare * i.w / open_w > 2 * i.size})
  FROM (SELECT *, list_sum(list_transform(items, lambda i: CASE WHEN i.full THEN 0 ELSE i.w END)) AS open_w FROM fill)
  WHERE open_w > 0 AND len(list_filter(items, lambda i: NOT i.full AND spare * i.w / open_w > 2 * i.size)) > 0),
last AS (SELECT spare, list_sum(list_transform(items, lambda i: CASE WHEN i.full THEN 0 ELSE i.w END)) AS open_w, unnest(items) AS i FROM fill WHERE step = (SELECT max(step) FROM fill)),
t AS (SELECT i.source AS source, i.size::BIGINT AS source_size, CASE WHEN i.full THEN 2 * i.size ELSE spare * i.w / open_w END::DOUBLE AS target FROM last),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS rank_words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + least(size, greatest(floor(target)::BIGINT - epochs * source_size - rank_words, 0)))::BIGINT AS taken, rank_words::BIGINT AS rank_words FROM e
"""


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.features(matroska.with_media(documents(spark, sf_dir))).drop("error")


def op5_exact_topk_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", hamming.sign_code("embedding").alias("code"))
    return hamming.top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


OP5_SQL = """
WITH c AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code))::INT AS distance FROM c q JOIN c r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank, vec_id, distance FROM p QUALIFY rank <= 10
"""


def op6_chat_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.maximal_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS part FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(part, '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM t),
e AS (SELECT min(conv_id) AS conv_id, n AS n_turns, count(*) AS n_copies, upto AS rendered FROM c WHERE pos = n GROUP BY n, upto)
SELECT * FROM e WHERE rendered NOT IN (SELECT upto FROM c WHERE pos < n)
"""

def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_fold("doc_id", 5) == 0
    lexicon = toxicity.fit(docs, labels(spark, sf_dir).where(~held))
    return toxicity.score(docs, lexicon).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "hits", "words")


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(documents(spark, sf_dir), pii_crf.fit())


def op9_language_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_fold("doc_id", 4) == 2
    model = langid.fit(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = documents(spark, sf_dir), crc_fold("doc_id", 3) == 1
    rows = checkpointed(pu_quality.measured(docs))
    model = pu_quality.fit(rows, labels(spark, sf_dir).where(~held))
    return pu_quality.score(rows, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    e = e.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(e, e.where(F.col("vec_id") % 100 == 0))


OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS alike, list_inner_product(a.v, r.v)::BIGINT AS score FROM e a JOIN e r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    d = d.withColumn("w", words).withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    d = d.withColumn("a", (F.col("g") % F.greatest("n", F.lit(1))).cast("int"))
    d = d.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    head, period = F.slice("w", F.lit(1), F.col("a")), F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.slice(F.concat(head, F.flatten(F.array_repeat(period, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))), F.lit(1), F.col("n"))
    d = d.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
    r = periodic.find(d)
    first = F.array_min(F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    r = r.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("m"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    r = r.withColumn("length", -F.col("m.l"))
    return r.select("doc_id", "n_runs", "m.start", "length", "m.period", F.floor(1000 * F.col("length") / F.col("m.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-
]+'), []) AS w,
  xor(list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295) AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM d), a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, g % 8 AS e FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + e) AS p FROM a),
u AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i, n, a, p, w FROM p),
x AS (SELECT doc_id, i, n, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE word END AS word FROM u),
e AS (SELECT l.doc_id, l.i, r.i - l.i AS q FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND l.i < r.i AND 2 * (r.i - l.i) <= l.n),
b AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island),
r AS (SELECT doc_id, start, length, min(q) AS period FROM b WHERE length >= 12 AND length >= 2 * q GROUP BY 1, 2, 3),
k AS (SELECT doc_id, count(*) AS n_runs, arg_min({'start': start, 'length': length, 'period': period}, {'l': -length, 'start': start, 'period': period}) AS m, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS collapsed_sha256 FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, m.start::BIGINT AS start, m.length::BIGINT AS length, m.period::BIGINT AS period, (1000 * m.length // m.period)::BIGINT AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op13_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_mixing_weights": op2_mixing_weights,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_media_matroska": op4_media_matroska,
    "op5_exact_topk_hamming": op5_exact_topk_hamming,
    "op6_chat_snapshot_collapse": op6_chat_snapshot_collapse,
    "op7_toxicity_lexicon": op7_toxicity_lexicon,
    "op8_pii_crf": op8_pii_crf,
    "op9_language_kernel": op9_language_kernel,
    "op10_quality_pu": op10_quality_pu,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_simhash_covering": op13_simhash_covering,
}
ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_mixing_weights": OP2_SQL,
    "op5_exact_topk_hamming": OP5_SQL,
    "op6_chat_snapshot_collapse": OP6_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
