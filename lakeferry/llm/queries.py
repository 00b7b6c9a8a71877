"""The queries of the corpus operators, with production parameters over whole tables, and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeferry.llm import bradley_terry, decontaminate, kd_sharding, mixing, ngram_join, quality_rules, substring_dedup, suffix_dedup, token_counts, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reach = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, d.component_id
FROM (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) d LEFT JOIN n USING (doc_id)
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35
), h AS (SELECT doc_id, p, md5(array_to_string(ws[p:p + 34], ' ')) AS k FROM s),
twice AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM h SEMI JOIN twice USING (k)),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bradley_terry.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def shard_digest(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(kd_sharding.shard_documents(table(spark, sf_dir, "documents"), 16))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source
), held AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0.0) AS held, coalesce(sum(w) OVER o, 0.0) AS used,
         sum(source_size) OVER () AS total, sum(w) OVER () AS weight
  FROM sources WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - held) / (weight - used) AS level FROM held
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, held) FROM levels WHERE level * w <= cap) * w, cap)) AS target FROM levels
), placed AS (
  SELECT *, size - size % (10 ** greatest(length(size::VARCHAR) - 2, 0))::BIGINT AS bin,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM sized
), ranked AS (
  SELECT p.doc_id, p.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS ratio,
         ('0x' || substr(md5('mix+' || coalesce('s' || p.source, 'n')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u,
         row_number() OVER (PARTITION BY p.source ORDER BY p.bin, p.h, p.doc_id) AS k
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(k * ratio + u) - floor((k - 1) * ratio + u), 3) * size)::BIGINT AS taken
FROM ranked
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM benchmark
), s AS (SELECT doc_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p, ws FROM d WHERE len(ws) >= 5),
ds AS (SELECT doc_id, n, p, array_to_string(ws[p:p + 4], ' ') AS g FROM s),
t AS (SELECT item_id, len(ws) AS n, unnest(range(1, len(ws) - 3)) AS p, ws FROM b WHERE len(ws) >= 5),
bs AS (SELECT item_id, n, p, array_to_string(ws[p:p + 4], ' ') AS g FROM t),
pairs AS (SELECT DISTINCT ds.doc_id, ds.n AS words, bs.item_id, bs.n AS len FROM ds JOIN bs USING (g)),
w AS (SELECT doc_id, item_id, len, least(len, words) AS size, unnest(range(1, greatest(words - len, 0) + 2)) AS f FROM pairs),
v AS (SELECT doc_id, item_id, size, f, unnest(range(0, size - 4)) AS j FROM w),
inside AS (SELECT v.doc_id, v.item_id, v.f, v.size, ds.g, count(*) AS c FROM v JOIN ds ON ds.doc_id = v.doc_id AND ds.p = v.f + v.j GROUP BY ALL),
own AS (SELECT item_id, g, count(*) AS c FROM bs GROUP BY ALL),
total AS (SELECT item_id, sum(c) AS c FROM own GROUP BY item_id),
scored AS (
  SELECT i.doc_id, i.item_id, i.f, i.size, sum(least(i.c, coalesce(o.c, 0)))::DOUBLE AS lesser, sum(i.c)::DOUBLE AS here
  FROM inside i LEFT JOIN own o ON o.item_id = i.item_id AND o.g = i.g GROUP BY ALL
), best AS (
  SELECT doc_id, item_id, lesser / (here + total.c - lesser) AS similarity, f, size,
         row_number() OVER (PARTITION BY doc_id, item_id ORDER BY lesser / (here + total.c - lesser) DESC, f) AS k
  FROM scored JOIN total USING (item_id)
)
SELECT doc_id, item_id, similarity, (f - 1)::BIGINT AS first_word, size::BIGINT AS n_words FROM best WHERE k = 1 AND similarity >= 0.8
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_ngram_join": op1_ngram_join, "op2_quality_rules": op2_quality_rules, "op3_suffix_dedup": op3_suffix_dedup, "op4_toxicity": op4_toxicity, "op5_substring_dedup": op5_substring_dedup, "op6_bradley_terry": op6_bradley_terry, "op7_kd_sharding": op7_kd_sharding, "op8_mixing": op8_mixing, "op9_decontaminate": op9_decontaminate, "op10_token_counts": op10_token_counts}
ORACLES = {"op1_ngram_join": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op8_mixing": OP8_SQL, "op9_decontaminate": OP9_SQL}
