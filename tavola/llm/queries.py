"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

import functools
import hashlib

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tavola.llm import ann, bpe, hard_negatives, html_text, language, licences, minhash, ngram_join, packing, quality, repeats, training_order, va_file
from tavola.llm.common import read_table, prepare, text_or_empty, written
from tavola.llm.vectors import integer_rows

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query
    return deco


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@register("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~F.coalesce(held_out(), F.lit(True))).select("text", "lang"))
    out = language.classify(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def classes_sql(percent: int, more: str = "") -> str:
    """Classes of linked 4-word shingle sets: all pairs that share a shingle, then all that links reach."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 2), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3])) END) AS shingle FROM d)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM shared JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= {percent} * (na.n + nb.n - c)),
both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS component_id{more}
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least_of m ON m.doc_id = d.doc_id
"""


@register("op2_ngram_join", classes_sql(85))
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.connect(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


@register("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    coded = docs.select("doc_id", bpe.round_trip(F.col("text"), TOKENIZER).alias("c")).select("doc_id", "c.*")
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op4_repeats")
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = repeats.remove_repeats(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
                      repeats.readable(F.col("kept")).alias("text"))


@register("op5_licences", licences.oracle())
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs).drop("text")


@register("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


@register("op7_nearest_neighbours")
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), TOKENIZER)


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pos AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM tri WHERE c > 1) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
   CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
   CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (base_failed) AS DOUBLE) AS k
  FROM judged GROUP BY source),
sums AS (
  SELECT sum(n) AS docs, sum(k) / sum(n) AS m, count(*) AS h, sum(k * k / n) / sum(n) AS sq FROM hosts),
prior AS (
  SELECT m, CASE WHEN sq - m * m - m * (1 - m) * h / docs > 0
   THEN least(1e6, greatest(1.0, m * (1 - m) / (sq - m * m - m * (1 - m) * h / docs) - 1))
   ELSE 1e6 END AS strength FROM sums),
verdict AS (
  SELECT source, (k + m * strength) / (n + strength) <= 0.75 AS host_kept FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND host_kept AS kept
FROM judged JOIN verdict ON judged.source IS NOT DISTINCT FROM verdict.source
"""


@register("op9_quality_rules", QUALITY_SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = written(quality.with_counts(docs).drop("text"), "counted")
    return (quality.judge(counted, quality.host_verdicts(counted))
            .select("doc_id", *quality.COUNTS, "base_failed", "kept"))


@register("op10_training_order")
def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = training_order.write_shards(read_table(spark, sf_dir, "documents"), TOKENIZER)
    return training_order.read_shards(spark, shards)


FINITE_SQL = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
FLOORS_SQL = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"       # integers, exact as doubles

NEGATIVES_SQL = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {FLOORS_SQL} AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {FINITE_SQL}),
pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
 CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
 n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


@register("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = integer_rows(read_table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id"), label.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


DIM, CENTROIDS, ROUNDS = 64, 40, 5      # of op12


def centroids_sql() -> str:
    """All distances to all centroids, one table of centroids a round."""
    steps = []
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
  SELECT vec_id, min({{'d': square - 2 * list_inner_product(v, c) + list_inner_product(c, c), 'cl': cl}}) AS n
  FROM v, cen{i} GROUP BY vec_id)""")
        if i < ROUNDS:
            steps.append(f"""cen{i + 1} AS MATERIALIZED (
  SELECT cen{i}.cl, coalesce(m.c, cen{i}.c) AS c FROM cen{i} LEFT JOIN (
    SELECT cl, list(x ORDER BY j) AS c FROM (
      SELECT cl, j, floor(sum(x) / count(*)) AS x FROM (
        SELECT n.n.cl AS cl, unnest(v.v) AS x, unnest(range({DIM})) AS j FROM near{i} n JOIN v USING (vec_id)) GROUP BY cl, j)
    GROUP BY cl) m USING (cl))""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, v, list_inner_product(v, v) AS square FROM (
    SELECT vec_id, {FLOORS_SQL} AS v FROM embeddings WHERE len(embedding) = {DIM} AND {FINITE_SQL})),
cen0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS cl, v AS c FROM v
  QUALIFY cl < {CENTROIDS}),
{", ".join(steps)}
SELECT vec_id, n.n.cl AS cluster, CAST(n.n.d AS BIGINT) AS distance,
 CAST(sum(n.n.d) OVER (PARTITION BY n.n.cl) AS BIGINT) AS cluster_inertia, CAST(sum(n.n.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN cen{ROUNDS} ON cen{ROUNDS}.cl = n.n.cl
"""


@register("op12_centroids", centroids_sql())
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_rows(read_table(spark, sf_dir, "embeddings"), "embedding", F.col("vec_id"), dim=DIM)
    found = va_file.cluster(rows, DIM, va_file.first_by_hash(rows, CENTROIDS, "2:"), ROUNDS)
    members = written(found.members, "members")
    sums = members.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    total = members.agg(F.try_sum("distance").alias("inertia"))
    codes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    of_cluster = (sums.join(spark.createDataFrame(codes, "cluster int, centroid_sha256 string"), "cluster")
                  .withColumn("inertia", F.lit(total.first().inertia).cast("long")))
    return (members.join(F.broadcast(of_cluster), "cluster")     # a row a centroid
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))


@register("op13_minhash", classes_sql(80, ", d.doc_id = least(d.doc_id, coalesce(m.least_id, d.doc_id)) AS kept"))
def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
