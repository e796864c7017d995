"""One query for each operator of this folder, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import dac, iblt, langid, lattice, mixing, multiorder, nnpu, spviterbi, suffixes, support, urlrep


def prepare(spark: SparkSession) -> None:
    ship(spark)
    support.small_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = [urlrep.Rule.parse(*r) for r in (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))]


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = support.new_path(spark, "token-codes")
    dac.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"), eos=2)
    return dac.read(spark, path)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    out = urlrep.judge(table(spark, sf_dir, "pages"), outcomes, RULES)
    return out.withColumn("bad_rate", F.round("bad_rate", 6)).withColumn("bound", F.round("bound", 6))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnpu.held_out_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", F.col("lang").alias("declared"), F.col("lang_id").alias("lang"), F.round("lang_posterior", 6).alias("posterior"), F.col("lang_kept").alias("kept"))


def op4_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "declared", F.col("lang_id").alias("lang"), F.round("lang_posterior", 6).alias("posterior"), F.col("lang_kept").alias("kept"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(table(spark, sf_dir, "documents"))


def op6_lattice_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near(table(spark, sf_dir, "embeddings"))


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.versions(table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.summary(mixing.mix(table(spark, sf_dir, "documents")))


def op9_piece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spviterbi.digest(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiorder.join(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_codes, op2_url_filter, op3_toxicity, op4_language_id, op4_page_languages, op5_suffix_dedup, op6_lattice_near, op7_iblt_fingerprints, op8_source_mix, op9_piece_viterbi, op10_ngram_join)}

_OP2 = f"""
WITH p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max(CAST(quality = 0 AS INT)) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM p LEFT JOIN o USING (page_id) GROUP BY 1),
names AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\\.?(?::[0-9]*)?\\z', '') AS name FROM h0),
parts AS (SELECT *, string_split(name, '.') AS l, regexp_extract(name, '{urlrep.TWO_LABELS}', 1) AS two, regexp_matches(name, '{urlrep.NUMERIC}') AS numeric FROM names),
h AS (SELECT host, n, k, CASE WHEN numeric THEN name WHEN two <> '' THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
             CASE WHEN numeric THEN name WHEN two <> '' THEN two ELSE l[-1] END AS suffix FROM parts),
t AS (SELECT CASE WHEN sum(n) > 0 THEN (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) ELSE 0.5 END AS m FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT m FROM t) AS m FROM h GROUP BY 1),
ss AS (SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(k / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / nullif(sum(n - 1), 0), 0.5))) - 1 AS s FROM s0 WHERE n > 0),
s1 AS (SELECT suffix, (s * m + k) / (s + n) AS post FROM s0, ss),
d0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k, any_value(post) AS m FROM h JOIN s1 USING (suffix) GROUP BY 1, 2),
ds AS (SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(k / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / nullif(sum(n - 1), 0), 0.5))) - 1 AS s FROM d0 WHERE n > 0),
d1 AS (SELECT domain, (s * m + k) / (s + n) AS post FROM d0, ds),
g0 AS (SELECT host, n, k, post AS m FROM h JOIN d1 USING (domain)),
gs AS (SELECT 1 / least(0.5, greatest(0.001, coalesce((sum(n * pow(k / n - m, 2) / greatest(m * (1 - m), 1e-9)) - count(*)) / nullif(sum(n - 1), 0), 0.5))) - 1 AS s FROM g0 WHERE n > 0),
r AS (SELECT host, s * m + k AS a, s + n - (s * m + k) AS b FROM g0, gs),
q AS (SELECT a, b, a * ln(a / (a + b)) + b * ln(b / (a + b)) AS top FROM (SELECT DISTINCT a, b FROM r)),
pts AS (SELECT a, b, i, exp(a * i * 0.1::DOUBLE - (a + b) * (greatest(i * 0.1::DOUBLE, 0) + ln(1 + exp(-abs(i * 0.1::DOUBLE)))) - top) AS d FROM q, range(-400, 401) t(i)),
ends AS (SELECT a, b, sum(d * CASE WHEN abs(i) = 400 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END) AS inner_, max(CASE WHEN i = -400 THEN d END) / a AS below, max(CASE WHEN i = 400 THEN d END) / b AS above FROM pts GROUP BY a, b),
cum AS (SELECT a, b, i, d * CASE WHEN abs(i) = 400 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END AS x, sum(d * CASE WHEN abs(i) = 400 THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END) OVER (PARTITION BY a, b ORDER BY i ROWS UNBOUNDED PRECEDING) AS c FROM pts),
hit AS (SELECT a, b, any_value(below) AS below, any_value(0.05::DOUBLE * (inner_ + below + above)) AS goal,
        arg_min((i - 0.5::DOUBLE + (0.05::DOUBLE * (inner_ + below + above) - below - (c - x)) / x) * 0.1::DOUBLE, i) FILTER (c + below >= 0.05::DOUBLE * (inner_ + below + above)) AS z FROM cum JOIN ends USING (a, b) GROUP BY a, b),
b AS (SELECT host, a / (a + b) AS mean, CASE WHEN below >= goal THEN 0 ELSE 1 / (1 + exp(-coalesce(z, 40))) END AS bound FROM r JOIN hit USING (a, b)),
m AS (SELECT page_id, host, path, mean, bound,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM p JOIN b USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.2 THEN 'block' ELSE 'allow' END AS verdict,
  round(mean, 6) AS bad_rate, round(bound, 6) AS bound
FROM m"""

_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v
      WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS m FROM r GROUP BY 1),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN k USING (vec_id)"""

_OP10 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS an, any_value(b.n) AS bn FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (an + bn - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM g LEFT JOIN m USING (doc_id)"""

ORACLES = {"op2_url_filter": _OP2, "op6_lattice_near": _OP6, "op10_ngram_join": _OP10}
