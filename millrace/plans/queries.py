"""Queries over the driver's tables, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions, text
from ..operators import cluster, columns, distance, distributions, evaluate, filters, generate, graph, learners, linalg, manifold, merges, ordered, recommend, sampling, sequence, sparse, stats, transforms
from ..session import ship
from ..streaming import online

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        run.__name__ = f.__name__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"]
NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def events_missing(t) -> DataFrame:
    """events with nulls: value of every 7th, event_type of every 11th."""
    return t("events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"))


MISSING = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS value, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type FROM events)"

# ---- aggregates and statistics ----------------------------------------------------------------------

_real = lambda c: f"SELECT '{c}' AS \"column\", 'real' AS kind, count({c}) AS n, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean, round(coalesce(stddev_samp({c}), 0), 6) AS dev, round(median({c}), 6) AS median, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS n_values, CAST(NULL AS DOUBLE) AS entropy, CAST(NULL AS VARCHAR) AS mode, CAST(NULL AS DOUBLE) AS mode_pct FROM lineitem"
_nom = lambda c: f"SELECT '{c}' AS \"column\", 'nominal' AS kind, CAST(sum(n) AS BIGINT) AS n, (SELECT count(*) - count({c}) FROM lineitem) AS missing, NULL, NULL, NULL, NULL, NULL, CAST(count(*) AS DOUBLE) AS n_values, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy, (array_agg(v ORDER BY n DESC, v))[1] AS mode, round(max(n) * 100.0 / sum(n), 6) AS mode_pct FROM (SELECT {c} AS v, count(*) AS n FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)"


@query(" UNION ALL ".join([*map(_real, NUMS), *map(_nom, ("l_returnflag", "l_linestatus"))]))
def stats_lineitem(t):
    return r6(stats.profile(t("lineitem"), [*NUMS, "l_returnflag", "l_linestatus"]).withColumn("n_values", F.col("n_values").cast("double")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(median({c}), 6) AS median FROM lineitem" for c in NUMS))
def colstats_lineitem(t):
    return r6(stats.col_stats(t("lineitem"), NUMS))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 6) AS covariance FROM lineitem" for a in NUMS for b in NUMS))
def covariance_lineitem(t):
    return r6(stats.covariance(t("lineitem"), NUMS))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS r, round(sum(l_quantity * l_extendedprice) / sqrt(sum(l_quantity * l_quantity) * sum(l_extendedprice * l_extendedprice)), 9) AS r0 FROM lineitem")
def correlation_lineitem(t):
    return r6(t("lineitem").agg(stats.correlation("l_quantity", "l_extendedprice").alias("r"), stats.correlation("l_quantity", "l_extendedprice", True).alias("r0")), 9)


@query(f"WITH n AS (SELECT user_id, event_type AS v, count(*) AS n FROM {MISSING} WHERE event_type IS NOT NULL GROUP BY 1, 2) SELECT user_id, 'event_type' AS \"column\", round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) AS entropy, (array_agg(v ORDER BY n DESC, v))[1] AS mode, round(max(n) / sum(n), 6) AS mode_share FROM n GROUP BY 1")
def entropy_per_user(t):
    return r6(stats.entropy(events_missing(t), ["event_type"], ["user_id"]))


@query(f"SELECT 'value' AS \"column\", round(avg(value), 6) AS mean, CAST(NULL AS VARCHAR) AS mode FROM {MISSING} UNION ALL SELECT 'event_type', NULL, (array_agg(v ORDER BY n DESC, v))[1] FROM (SELECT event_type AS v, count(*) AS n FROM {MISSING} WHERE event_type IS NOT NULL GROUP BY 1)")
def baseline_events(t):
    return r6(stats.baseline(events_missing(t), ["value", "event_type"]))


@query(f"SELECT round((SELECT coalesce(var_samp(value), 0) FROM {MISSING}) + (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*) AS n FROM {MISSING} WHERE event_type IS NOT NULL GROUP BY event_type)), 6) AS information")
def information_events(t):
    return r6(stats.information(events_missing(t), ["value", "event_type"]))


@query(f"SELECT least(count(DISTINCT event_type) + max(CAST(event_type IS NULL AS INT)), 4) AS n_unique FROM {MISSING}")
def count_unique_capped(t):
    return stats.count_unique(events_missing(t), "event_type", 4)


@query(f"SELECT bool_or(value IS NULL OR event_type IS NULL) AS any_missing FROM {MISSING}")
def any_missing(t):
    return stats.has_missing(events_missing(t))


@query("SELECT round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_mean, round(sum(l_quantity * l_quantity), 3) AS squared_magnitude, sum(CAST(l_quantity = 5 AS INT)) AS n5 FROM lineitem")
def weighted_mean_lineitem(t):
    return t("lineitem").agg(F.round(stats.weighted_mean("l_extendedprice", "l_quantity"), 6).alias("weighted_mean"), F.round(stats.squared_magnitude("l_quantity"), 3).alias("squared_magnitude"), F.count_if(F.col("l_quantity") == 5).alias("n5"))


@query("WITH m AS (SELECT sum(l_quantity * l_tax) / sum(l_tax) AS a, sum(l_discount * l_tax) / sum(l_tax) AS b FROM lineitem) SELECT round(sum(l_tax * l_tax * (l_quantity - a) * (l_discount - b)) / greatest(1e-6, sum(l_tax) - 1), 9) AS covariance FROM lineitem, m")
def weighted_covariance_lineitem(t):
    return r6(stats.weighted_covariance(t("lineitem"), "l_quantity", "l_discount", "l_tax"), 9)


@query("WITH d AS (SELECT abs(l_discount * 100 - l_quantity / 5) AS m, l_discount * 100 - l_quantity / 5 > 0 AS up FROM lineitem WHERE abs(l_discount * 100 - l_quantity / 5) > 0.05), r AS (SELECT up, rank() OVER (ORDER BY round(m, 6)) + (count(*) OVER (PARTITION BY round(m, 6)) - 1) / 2.0 AS r FROM d) SELECT count(*) AS n, sum(CASE WHEN up THEN 0 ELSE r END) AS w_minus, sum(CASE WHEN up THEN r ELSE 0 END) AS w_plus FROM r")
def wilcoxon_lineitem(t):
    x = t("lineitem").select(F.round(F.col("l_discount") * 100 - F.col("l_quantity") / 5, 6).alias("d"), F.lit(0.0).alias("z"))
    return stats.wilcoxon_ranks(x, "d", "z", 0.05)


@query("SELECT median(l_discount) AS median_a, median(l_tax) AS median_b, round(avg(l_discount), 9) AS mean_a, round(avg(l_tax), 9) AS mean_b, CAST(sum(CAST(l_discount - l_tax < -0.001 AS INT)) AS BIGINT) AS less, CAST(sum(CAST(l_discount - l_tax > 0.001 AS INT)) AS BIGINT) AS greater, round(abs(avg(l_tax) - avg(l_discount)) / sqrt((var_samp(l_tax) + var_samp(l_discount)) / count(*)), 6) AS t, round(avg(l_discount - l_tax) / sqrt(var_samp(l_discount - l_tax) / count(*)), 6) AS t_paired FROM lineitem")
def significance_lineitem(t):
    x = stats.significance(t("lineitem"), "l_discount", "l_tax")
    return x.select("median_a", "median_b", F.round("mean_a", 9).alias("mean_a"), F.round("mean_b", 9).alias("mean_b"), "less", "greater", F.round("t", 6).alias("t"), F.round("t_paired", 6).alias("t_paired"))


@query("SELECT round(sum(power(l_quantity - l_discount, 2)), 3) AS sse, round(avg(abs((l_quantity - l_discount) / l_quantity)), 9) AS mape, round(sqrt(avg(power(l_quantity - l_discount, 2))), 9) AS rmse FROM lineitem")
def calc_error_lineitem(t):
    e = lambda k: stats.calc_error(t("lineitem"), "l_quantity", "l_discount", k)
    return t("lineitem").agg(F.round(e("SSE"), 3).alias("sse"), F.round(e("MAPE"), 9).alias("mape"), F.round(e("RMSE"), 9).alias("rmse"))


@query("WITH s AS (SELECT count(value) AS n, median(value) AS m, stddev_samp(value) AS d, min(value) AS a, max(value) AS z FROM events), b AS (SELECT greatest(a, m - 4 * d) AS lo, least(z, m + 4 * d) AS hi, n FROM s) SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS BIGINT) AS bin, round(lo + CAST(least(floor((value - lo) / ((hi - lo) / 20)), 19) AS BIGINT) * ((hi - lo) / 20), 6) AS lo, count(*) AS n FROM events, b WHERE value BETWEEN lo AND hi GROUP BY 1, 2")
def histogram_events(t):
    return r6(stats.histogram(t("events"), "value", 20).select("bin", "lo", "n"))


@query("SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1")
def nominal_histogram_events(t):
    return r6(stats.nominal_histogram(t("events"), "event_type"), 9)


@query("SELECT u - 1 AS pos, round(avg(x), 6) AS value FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS u FROM embeddings) GROUP BY 1")
def centroid_embeddings(t):
    return r6(stats.array_centroid(t("embeddings"), "embedding"))


@query("SELECT round(sum(power(l_quantity - 25, 2) + power(l_discount - 0.05, 2)), 3) AS sum_squared_distance FROM lineitem")
def sum_squared_distance_lineitem(t):
    return r6(stats.sum_squared_distance(t("lineitem"), ["l_quantity", "l_discount"], [25.0, 0.05]), 3)


@query("SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY event_type) + (count(*) OVER (PARTITION BY user_id, event_type) - 1) / 2.0 AS average_rank FROM events")
def average_rank_events(t):
    return stats.average_rank(t("events"), ["user_id"], "event_type").select("user_id", "event_id", "average_rank")


@query()
def bounding_sphere_lineitem(t):
    c, r = stats.bounding_sphere(t("lineitem"), ["l_discount", "l_tax"])
    return t("region").sparkSession.createDataFrame([(c[0], c[1], r)], "x double, y double, radius double")


@query()
def meta_features_orders(t):
    return stats.meta_features(t("orders").select("o_orderstatus", "o_totalprice", "o_orderpriority"), "o_orderpriority")


@query("WITH x AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value, user_id::DOUBLE AS u FROM events), n AS (SELECT max(i) AS m FROM x), s AS (SELECT sum(power(0.999, m - i)) AS k, sum(power(0.999, m - i) * value) AS sx, sum(power(0.999, m - i) * u) AS sy, sum(power(0.999, m - i) * value * u) AS xy FROM x, n) SELECT 'value' AS a, 'user_id' AS b, round(k / (k - 1) * (xy / k - sx / k * (sy / k)), 4) AS covariance FROM s")
def decayed_covariance_events(t):
    return r6(stats.decayed_covariance(t("events"), ["event_id"], ["value", "user_id"], 0.999).filter("a <> b"), 4)


# ---- columns ----------------------------------------------------------------------------------------


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) - min(value) FROM events)) * 2 - 1, 6) AS value FROM events")
def normalize_events(t):
    return r6(columns.normalize(t("events").select("event_id", "value"), -1, 1, ["value"]))


@query(f"SELECT event_id, CASE WHEN value IS NULL THEN NULL ELSE least(greatest(floor((value - a) * 10.0 / (z - a)), 0), 9) END AS value FROM {MISSING}, (SELECT min(value) AS a, max(value) AS z FROM {MISSING})")
def discretize_events(t):
    return columns.discretize(events_missing(t).select("event_id", "value"), ["value"], 10)


@query(f"SELECT event_id, CASE WHEN value <= 100 THEN 0.0 WHEN value > 100 THEN 1.0 END AS value FROM {MISSING}")
def threshold_events(t):
    return columns.threshold(events_missing(t).select("event_id", "value"), "value", 100)


@query("SELECT event_id, round(value - (SELECT avg(value) FROM events), 6) AS value FROM events")
def zero_mean_events(t):
    return r6(columns.zero_mean(t("events").select("event_id", "value"), ["value"]))


@query("SELECT event_id, round(value - (SELECT value FROM events ORDER BY event_id LIMIT 1 OFFSET 17), 6) AS value FROM events")
def center_events(t):
    return r6(columns.center(t("events").select("event_id", "value"), ["event_id"], 17, ["value"]))


@query("SELECT event_id, round(value * cos(radians(30)) - user_id * sin(radians(30)), 6) AS value, round(value * sin(radians(30)) + user_id * cos(radians(30)), 6) AS user_id FROM events")
def rotate_events(t):
    return r6(columns.rotate(t("events").select("event_id", "value", "user_id"), "value", "user_id", 30))


_LAT, _LON = "(event_id * 37 % 180 - 90)", "(event_id * 91 % 360 - 180)"
_HAV = f"(power(sin(radians(48.0 - {_LAT}) / 2), 2) + cos(radians({_LAT})) * cos(radians(48.0)) * power(sin(radians(11.0 - {_LON}) / 2), 2))"


@query(f"SELECT event_id, round(12742.0 * atan2(sqrt({_HAV}), sqrt(1 - {_HAV})), 3) AS km FROM events")
def geodistance_events(t):
    lat, lon = F.col("event_id") * 37 % 180 - 90, F.col("event_id") * 91 % 360 - 180
    return r6(t("events").select("event_id", columns.geodistance(lat, lon, F.lit(48.0), F.lit(11.0)).alias("km")), 3)


@query("SELECT o_orderkey, round(power(o_totalprice * 2 + 10, 0.5), 6) AS o_totalprice FROM orders")
def scale_shift_power_orders(t):
    x = t("orders").select("o_orderkey", "o_totalprice")
    return r6(columns.power(columns.shift(columns.scale(x, ["o_totalprice"], 2), ["o_totalprice"], 10), ["o_totalprice"], 0.5))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice), 9) AS l_quantity, round(l_extendedprice / sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice), 9) AS l_extendedprice FROM lineitem")
def normalize_magnitude_lineitem(t):
    return r6(columns.normalize_magnitude(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"), ["l_quantity", "l_extendedprice"]), 9)


@query("SELECT o_orderkey, " + ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1.0 ELSE 0.0 END AS \"o_orderpriority_{v}\"" for v in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders")
def one_hot_orders(t):
    return columns.one_hot(t("orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@query("WITH f AS (SELECT event_type, min(event_id) AS a FROM events GROUP BY 1), c AS (SELECT event_type, row_number() OVER (ORDER BY a) - 1 AS code FROM f) SELECT event_id, CAST(code AS DOUBLE) AS event_type FROM events JOIN c USING (event_type)")
def enumerate_values_events(t):
    return columns.enumerate_values(t("events").select("event_id", "event_type"), ["event_id"], "event_type")


@query("SELECT 10 + 5 * (row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) AS index, o_orderkey, o_totalprice FROM orders")
def add_index_orders(t):
    return columns.add_index(t("orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 10, 5)


@query("SELECT c_acctbal, c_nationkey, c_name, c_custkey, 'c' AS kind FROM customer")
def column_lists_customer(t):
    x = columns.drop_columns(columns.reorder_columns(t("customer"), "3-0,*0"), "*0")
    return columns.add_category(x, "kind", "c")


@query("SELECT n_name, n_nationkey FROM nation")
def swap_and_drop_homogeneous_nation(t):
    x = t("nation").select("n_nationkey", "n_name", F.lit(1).alias("same"))
    return columns.swap_columns(columns.drop_homogeneous(x), 0, 1)


@query("SELECT 'n_nationkey' AS \"column\", " + ", ".join(f"max(CASE WHEN n_nationkey = {i} THEN n_nationkey END) AS c{i}" for i in range(25)) + " FROM nation UNION ALL SELECT 'n_regionkey', " + ", ".join(f"max(CASE WHEN n_nationkey = {i} THEN n_regionkey END)" for i in range(25)) + " FROM nation")
def transpose_nation(t):
    return columns.transpose(t("nation"), ["n_nationkey"], ["n_nationkey", "n_regionkey"])


# ---- filters ----------------------------------------------------------------------------------------


@query(f"SELECT event_id FROM {MISSING} WHERE value BETWEEN 50 AND 100")
def filter_rows_events(t):
    return filters.filter_rows(events_missing(t), "value", 50, 100).select("event_id")


@query(f"SELECT event_id FROM {MISSING} WHERE NOT coalesce(value BETWEEN 50 AND 100, FALSE)")
def filter_rows_inverted_events(t):
    return filters.filter_rows(events_missing(t), "value", 50, 100, invert=True).select("event_id")


@query(f"SELECT event_id, CASE WHEN value BETWEEN 50 AND 100 THEN value END AS value FROM {MISSING}")
def filter_elements_events(t):
    return filters.filter_elements(events_missing(t), "value", 50, 100).select("event_id", "value")


@query(f"SELECT event_id FROM {MISSING} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing_events(t):
    return filters.drop_missing(events_missing(t)).select("event_id")


@query(f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {MISSING})), 6) AS value, coalesce(event_type, (SELECT (array_agg(v ORDER BY n DESC, v))[1] FROM (SELECT event_type AS v, count(*) AS n FROM {MISSING} WHERE event_type IS NOT NULL GROUP BY 1))) AS event_type FROM {MISSING}")
def fill_missing_events(t):
    return r6(sampling.fill_missing(events_missing(t).select("event_id", "value", "event_type"), ["value", "event_type"]))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 1")
def unique_first_events(t):
    return filters.unique(t("events").select("event_id", "user_id"), "user_id", ["event_id"])


@query("SELECT max(event_id) AS event_id, user_id FROM events GROUP BY 2")
def unique_last_events(t):
    return filters.unique(t("events").select("event_id", "user_id"), "user_id", ["event_id"], last=True)


@query("SELECT c_nationkey, count(*) AS n, sum(c_custkey) AS total FROM customer GROUP BY 1 HAVING count(*) >= 2")
def duplicate_keys_customer(t):
    x = filters.duplicate_keys(t("customer"), "c_nationkey", "c_custkey")
    return x.select("c_nationkey", "n", F.aggregate("values", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("total"))


@query("WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s FROM events), k(user_id, event_id, s) AS (SELECT user_id, arg_min(event_id, s), min(s) FROM e GROUP BY 1 UNION ALL SELECT k.user_id, n.event_id, n.s FROM k, LATERAL (SELECT event_id, s FROM e WHERE e.user_id = k.user_id AND e.s >= k.s + 86400 ORDER BY s LIMIT 1) n) SELECT user_id, event_id FROM k")
def thin_events(t):
    x = t("events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("s"))
    return filters.thin(x, ["user_id"], "s", "s", 86400.0).select("user_id", "event_id")


@query()
def drop_random_values_events(t):
    return filters.drop_random_values(t("events").select("event_id", "user_id", "value"), 0.1, ["event_id"], ["user_id", "value"])


# ---- positional merges ------------------------------------------------------------------------------


@query("SELECT a.o_orderkey, a.o_totalprice, b.o_orderkey AS o_orderkey_2 FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) b USING (i)")
def merge_horizontal_orders(t):
    o = t("orders")
    return merges.merge_horizontal(o.select("o_orderkey", "o_totalprice"), ["o_orderkey"], o.select("o_orderkey", F.col("o_totalprice").alias("p")), ["p", "o_orderkey"]).select("o_orderkey", "o_totalprice", "o_orderkey_2")


@query(f"SELECT e.event_id, coalesce(m.value, e.value * 2) AS value FROM events e JOIN {MISSING} m USING (event_id)")
def overlay_events(t):
    base = t("events").select("event_id", (F.col("value") * 2).alias("value"))
    return merges.overlay(base, ["event_id"], events_missing(t).select("event_id", "value"), ["event_id"], ["value"])


@query("SELECT event_id, round(value * 3, 6) AS value FROM events")
def add_events(t):
    x = t("events").select("event_id", "value")
    return r6(merges.add(x, ["event_id"], x.withColumn("value", F.col("value") * 2), ["event_id"], ["value"]))


@query(f"SELECT 'value' AS \"column\", round(sum(CASE WHEN m.value IS NOT NULL THEN power(e.value - m.value * 1.1, 2) ELSE 0 END) / count(*), 6) AS mse FROM events e JOIN {MISSING} m USING (event_id)")
def mean_squared_error_events(t):
    return r6(merges.mean_squared_error(t("events"), ["event_id"], events_missing(t).withColumn("value", F.col("value") * 1.1), ["event_id"], ["value"]))


@query("SELECT round(sum(power(value * 0.1, 2)), 3) AS sum, round(sum(power(value * 0.1, 2)) / count(*), 6) AS mean, round(sqrt(sum(power(value * 0.1, 2)) / count(*)), 6) AS rms FROM events")
def squared_distance_events(t):
    x = merges.squared_distance(t("events"), ["event_id"], t("events").withColumn("value", F.col("value") * 1.1), ["event_id"], ["value"])
    return x.select(F.round("sum", 3).alias("sum"), F.round("mean", 6).alias("mean"), F.round("rms", 6).alias("rms"))


@query(f"SELECT 'event_type' AS \"column\", round(avg(CAST(e.event_type IS NOT DISTINCT FROM m.event_type AS DOUBLE)) * 100, 6) AS percent FROM events e JOIN {MISSING} m USING (event_id)")
def percent_same_events(t):
    return r6(merges.percent_same(t("events"), ["event_id"], events_missing(t), ["event_id"], ["event_type"]))


@query(f"SELECT 'value' AS \"column\", round(sum(power(e.value - m.value * 2, 2)), 3) AS squared, round(sum(abs(e.value - m.value * 2)), 3) AS absolute FROM events e JOIN {MISSING} m USING (event_id) UNION ALL SELECT 'event_type', sum(CASE WHEN e.event_type <> m.event_type THEN 1.0 ELSE 0.0 END), sum(CASE WHEN e.event_type <> m.event_type THEN 1.0 ELSE 0.0 END) FROM events e JOIN {MISSING} m USING (event_id)")
def column_differences_events(t):
    return r6(merges.column_differences(t("events"), ["event_id"], events_missing(t).withColumn("value", F.col("value") * 2), ["event_id"], ["value", "event_type"]), 3)


@query("SELECT * FROM (SELECT event_type, value, lead(value) OVER (ORDER BY event_id) AS next_value, row_number() OVER (ORDER BY event_id DESC) AS r FROM events) WHERE r > 1".replace("SELECT *", "SELECT event_type, value, next_value"))
def transition_events(t):
    return merges.transition(t("events"), ["event_id"], ["event_type"], ["value"])


@query("SELECT c_custkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def merge_vertical_accounts(t):
    return merges.merge_vertical(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("b")), t("supplier").select("s_suppkey", "s_acctbal"), force=True)


@query("SELECT coalesce(a.i, b.i) AS row_id, a.r_name AS regions, b.n_name AS nations FROM (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS i, r_name FROM region) a FULL JOIN (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS i, n_name FROM nation) b ON a.i = b.i")
def aggregate_columns_names(t):
    return merges.aggregate_columns({"regions": (t("region").withColumnRenamed("r_name", "name"), ["r_regionkey"]), "nations": (t("nation").withColumnRenamed("n_name", "name"), ["n_nationkey"])}, "name")


@query("(SELECT 'customer' AS \"table\", c_name AS name FROM customer ORDER BY c_custkey LIMIT 1 OFFSET 3) UNION ALL (SELECT 'supplier', s_name FROM supplier ORDER BY s_suppkey LIMIT 1 OFFSET 3)")
def aggregate_rows_names(t):
    return merges.aggregate_rows({"customer": (t("customer").select("c_custkey", F.col("c_name").alias("name")), ["c_custkey"]), "supplier": (t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name")), ["c_custkey"])}, 3).drop("c_custkey")


@query()
def align_lineitem(t):
    x = t("events").select("event_id", "value", F.col("user_id").cast("double").alias("u"))
    return r6(merges.align(x, ["event_id"], columns.rotate(x, "value", "u", 25), ["event_id"], ["value", "u"]), 3)


@query()
def bipartite_matching_suppliers(t):
    """Mean balance of each nation's suppliers against that of each nation's customers; all rows of both count."""
    a = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.avg("s_acctbal").alias("x"))
    return merges.bipartite_matching(a, "k", t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("c_acctbal").alias("x")), "k", ["x"])


# ---- order ------------------------------------------------------------------------------------------


@query("SELECT event_id, round(sum(value) OVER (ORDER BY event_id), 3) AS value FROM events")
def cumulative_events(t):
    return r6(ordered.cumulative(t("events").select("event_id", "value"), ["event_id"], ["value"]), 3)


@query("WITH x AS (SELECT row_number() OVER (ORDER BY event_id) AS i, value - (SELECT avg(value) FROM events) AS d FROM events) SELECT CAST(l AS INT) AS lag, round(avg(a.d * b.d), 4) AS value FROM range(1, 21) r(l), x a JOIN x b ON b.i = a.i + r.l GROUP BY 1")
def autocovariance_events(t):
    return r6(ordered.autocovariance(t("events"), ["event_id"], "value", 20), 4)


@query("WITH x AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS a FROM events) SELECT user_id, round(sum(power(0.9, a) * value) / sum(power(0.9, a)), 6) AS decayed_mean FROM x GROUP BY 1")
def decayed_mean_events(t):
    return r6(ordered.decayed_mean(t("events"), ["event_id"], "value", 0.9, ["user_id"]))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS row_id FROM orders")
def reverse_rows_orders(t):
    return sampling.reverse_rows(t("orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "row_id")


@query("SELECT o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 100")
def nth_element_orders(t):
    return sampling.nth_element(t("orders"), "o_totalprice", 100)


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) WHERE i % 7 = 0")
def every_seventh_order(t):
    return sampling.every_nth(t("orders"), ["o_orderkey"], 7).select("o_orderkey")


@query("SELECT part, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM (SELECT CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 1000 THEN 'first' ELSE 'rest' END AS part, o_totalprice FROM orders) GROUP BY 1")
def split_orders(t):
    a, b = sampling.split(t("orders"), ["o_orderkey"], 1000)
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean")).select(F.lit(n).alias("part"), "n", "mean")
    return r6(one(a, "first").union(one(b, "rest")))


@query("WITH x AS (SELECT l_quantity, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT CAST(i >= n * 2 // 5 AND i < n * 3 // 5 AS INT) AS test, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM x GROUP BY 1")
def split_fold_lineitem(t):
    a, b = sampling.split_fold(t("lineitem"), LINE, 2, 5)
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")).select(F.lit(n).alias("test"), "n", "mean")
    return r6(one(a, 0).union(one(b, 1)))


@query(f"SELECT 'low' AS side, count(*) AS n FROM {MISSING} WHERE value < 100 OR (value IS NULL AND (SELECT sum(CAST(value < 100 AS INT)) >= sum(CAST(value >= 100 AS INT)) FROM {MISSING})) UNION ALL SELECT 'high', count(*) FROM {MISSING} WHERE value >= 100 OR (value IS NULL AND (SELECT sum(CAST(value < 100 AS INT)) < sum(CAST(value >= 100 AS INT)) FROM {MISSING}))")
def split_value_events(t):
    a, b = sampling.split_value(events_missing(t), "value", 100)
    return a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("low").alias("side"), "n").union(b.agg(F.count(F.lit(1)).alias("n")).select(F.lit("high").alias("side"), "n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def split_class_events(t):
    out = None
    for v, d in sampling.split_class(t("events"), "event_type", drop=True).items():
        x = d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("event_type"), "n")
        out = x if out is None else out.union(x)
    return out


@query("SELECT count(*) AS n, sum(row_id) AS total FROM (SELECT row_number() OVER () - 1 AS row_id FROM orders)")
def shuffle_orders(t):
    return sampling.shuffle(t("orders"), ["o_orderkey"], 3).agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("total"))


@query()
def sample_rows_orders(t):
    return sampling.sample_rows(t("orders"), 0.1, 1).select("o_orderkey")


@query()
def bootstrap_orders(t):
    return sampling.bootstrap(t("orders"), 1.0, 1).groupBy("o_orderkey").count()


# ---- expressions ------------------------------------------------------------------------------------


@query("SELECT event_id, round(1 / (1 + exp(-(value - 100) / 50)), 9) AS f1, round(greatest(value, user_id) % 7, 6) AS f2, round(CASE WHEN value - 100 < 0 THEN -sqrt(abs(value - 100)) ELSE ln(value) END, 9) AS f3, CASE WHEN user_id - 5 >= 0 THEN 1.0 ELSE -1.0 END AS f4, round(0.39894228 * exp(-power(value / 100, 2) / 2), 9) AS f5 FROM events")
def function_events(t):
    x = t("events").select("value", F.col("user_id").cast("double").alias("u"), "event_id")
    return r6(expressions.apply_functions(x, "sq(a)=a^2; f1(x)=1/(1+e^-((x-100)/50)); f2(x,u)=max(x,u)%7; f3(x)=ifnegative(x-100,-sqrt(abs(x-100)),log(x)); f4(x,u)=sign(u-5); f5(x)=0.39894228*e^(-sq(x/100)/2)", ["value", "u"], ["event_id"]), 9)


@query("SELECT a.s_suppkey, round(sum(exp(-power((a.s_acctbal - b.s_acctbal) / 500, 2))) / (SELECT count(*) FROM supplier), 9) AS f1 FROM supplier a, supplier b GROUP BY 1")
def function2_density_suppliers(t):
    s = t("supplier")
    n = s.count()
    return r6(expressions.pair_sums(s, "s_suppkey", f"g1(x,y)=e^(-((x-y)/500)^2); f1(x,h)=h/{n}", ["s_acctbal"]), 9)


@query("SELECT n_nationkey, round(gamma(n_nationkey + 1.5) / power(10, n_nationkey), 6) AS g, round(lgamma(n_nationkey + 1.5), 6) AS lg FROM nation")
def gamma_nation(t):
    x = t("nation").select("n_nationkey", (F.col("n_nationkey") + 1.5).alias("x"))
    return x.select("n_nationkey", F.round(expressions.BUILT_IN["gamma"](F.col("x")) / F.pow(F.lit(10.0), "n_nationkey"), 6).alias("g"), F.round(expressions.BUILT_IN["lgamma"](F.col("x")), 6).alias("lg"))


@query("""WITH x AS (SELECT n_nationkey, n_nationkey / 10.0::DOUBLE AS x FROM nation),
s AS (SELECT n_nationkey, sum(power(2.0::DOUBLE, n) * power(x, 2 * n + 1) / list_product(list_transform(range(0, n + 1), lambda i: 2.0::DOUBLE * i + 1))) AS s, any_value(x) AS x FROM x, range(0, 80) r(n) GROUP BY 1)
SELECT n_nationkey, round(2 / sqrt(pi()) * exp(-x * x) * s, 6) AS e FROM s""")
def erf_nation(t):
    return r6(t("nation").select("n_nationkey", expressions.BUILT_IN["erf"](F.col("n_nationkey") / 10).alias("e")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_path_events(t):
    return t("events").select("event_id", text.json_path(F.col("props"), ".k").cast("int").alias("k"))


@query("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS s FROM events")
def time_parse_events(t):
    x = t("events").select("event_id", F.date_format(F.date_trunc("second", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("x"))
    return x.select("event_id", text.seconds_of(F.col("x"), "YYYY-MM-DD hh:mm:ss").alias("s"))


@query("SELECT page_id, sha256(html) AS h FROM pages")
def sha_pages(t):
    return t("pages").select("page_id", F.sha2("html", 256).alias("h"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def html_attribute_pages(t):
    return t("pages").select("page_id", F.coalesce(text.attribute(F.col("html"), "html", "lang"), F.lit("")).alias("lang"))


@query()
def html_text_pages(t):
    return t("pages").select("page_id", text.visible_text("html").alias("text"))


# ---- matrices ---------------------------------------------------------------------------------------


@query(" UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, round(sum({a} * {b}), 2) AS value FROM lineitem" for i, a in enumerate(NUMS) for j, b in enumerate(NUMS)))
def multiply_gram_lineitem(t):
    m = linalg.to_triples(t("lineitem"), LINE, NUMS)
    return r6(linalg.multiply(m, m, transpose_a=True), 2)


@query("SELECT CAST(n_regionkey AS BIGINT) AS trace FROM nation WHERE n_nationkey = 0")
def trace_nation(t):
    x = linalg.to_triples(t("nation"), ["n_nationkey"], ["n_regionkey"])
    return linalg.trace(x.filter("j = 0")).select(F.col("trace").cast("bigint").alias("trace"))


@query()
def svd_lineitem(t):
    df, s, v = linalg.svd(t("lineitem"), NUMS, 2)
    return t("region").sparkSession.createDataFrame([(i, float(x), [float(a) for a in r]) for i, (x, r) in enumerate(zip(s, np.abs(v)))], "i int, value double, vector array<double>")


@query()
def driver_algebra(t):
    g, _, _ = linalg.gram(t("lineitem"), NUMS, center=True)
    spark = t("region").sparkSession
    parts = {"cholesky": linalg.cholesky(g), "pseudo_inverse": linalg.pseudo_inverse(g), "row_echelon": linalg.row_echelon(g)}
    rows = [(k, i, j, float(m[i, j])) for k, m in parts.items() for i in range(4) for j in range(4)] + [("determinant", 0, 0, linalg.determinant(g))]
    return spark.createDataFrame(rows, "what string, i int, j int, value double")


# ---- transforms -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, round(ln(o_totalprice), 9) AS o_totalprice FROM orders")
def log_transform_orders(t):
    x = t("orders").select("o_orderkey", "o_totalprice")
    return r6(transforms.Log(cols=["o_totalprice"]).fit(x).transform(x), 9)


@query("SELECT event_id, round((value - a) / (z - a), 6) AS value FROM events, (SELECT min(value) AS a, max(value) AS z FROM events)")
def normalize_model_events(t):
    x = t("events").select("event_id", "value")
    m = transforms.load_transform(transforms.Chain([transforms.Normalize(cols=["value"])]).fit(x).to_json())
    return r6(m.transform(x))


@query("SELECT event_id, value, user_id, round(value * value, 4) AS \"value*value\", round(user_id * value, 4) AS \"user_id*value\", user_id * user_id AS \"user_id*user_id\" FROM events")
def pair_products_events(t):
    x = t("events").select("event_id", "value", "user_id")
    return transforms.PairProducts(cols=["value", "user_id"]).fit(x).transform(x).select("event_id", "value", "user_id", F.round("value*value", 4).alias("value*value"), F.round("user_id*value", 4).alias("user_id*value"), "user_id*user_id")


@query()
def pca_lineitem(t):
    x = t("lineitem").select("l_orderkey", *NUMS)
    return transforms.PCA(cols=NUMS, k=2).fit(x).transform(x)


@query()
def impute_events(t):
    return transforms.impute(events_missing(t).select("event_id", "value", F.col("user_id").cast("double").alias("u")), "event_id", ["value", "u"])


@query()
def self_organizing_map_lineitem(t):
    x = columns.normalize(t("lineitem").select(*NUMS), cols=NUMS)
    return transforms.SelfOrganizingMap(cols=NUMS, grid=(3, 3), rounds=4).fit(x).transform(x).groupBy("map_row", "map_col").agg(F.count(F.lit(1)).alias("n"))


# ---- distances and neighbours -----------------------------------------------------------------------

_VEC = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"


@query(f"WITH v AS ({_VEC}), d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda p: power(p[1] - p[2], 2)))) AS distance FROM v a, v b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query, neighbour, round(distance, 6) AS distance, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS r FROM d) WHERE r <= 5")
def nearest_embeddings(t):
    e = t("embeddings")
    return r6(distance.nearest(e.filter("vec_id % 20 = 0"), e, "vec_id", ["embedding"], 5))


@query("WITH d AS (SELECT a.s_suppkey AS q, abs(a.s_acctbal - b.s_acctbal) AS d, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS r FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey) SELECT round(avg(CASE WHEN r = 1 THEN d END), 6) AS mean_nearest, round(avg(d), 6) AS mean_k, round(median(CASE WHEN r = 4 THEN d END), 6) AS median_kth FROM d WHERE r <= 4")
def neighbours_suppliers(t):
    return r6(distance.neighbour_summary(t("supplier"), "s_suppkey", ["s_acctbal"], 4))


@query(f"WITH v AS ({_VEC}), z AS (SELECT e FROM v WHERE vec_id = 0) SELECT vec_id, round(1 - list_inner_product(v.e, z.e) / sqrt(list_inner_product(v.e, v.e) * list_inner_product(z.e, z.e)), 6) AS cosine, round(power(list_inner_product(v.e, z.e) + 1, 2), 6) AS poly, round(exp(-list_sum(list_transform(list_zip(v.e, z.e), lambda p: power(p[1] - p[2], 2))) / 2), 6) AS rbf FROM v, z")
def kernels_embeddings(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    z = F.array(*map(F.lit, e.filter("vec_id = 0").first()["e"]))
    return r6(e.select("vec_id", distance.cosine_distance(F.col("e"), z).alias("cosine"), distance.kernel_polynomial(1.0, 2)(F.col("e"), z).alias("poly"), distance.kernel_rbf(1.0)(F.col("e"), z).alias("rbf")))


@query(f"SELECT event_id, round(power((value - 100) * 0.01, 2) + CASE WHEN event_type IS NULL THEN 1.0 WHEN event_type = 'click' THEN 0.0 ELSE 1.0 END, 6) AS d FROM (SELECT event_id, value, event_type FROM {MISSING}) WHERE value IS NOT NULL UNION ALL SELECT event_id, round(1.0 + CASE WHEN event_type IS NULL THEN 1.0 WHEN event_type = 'click' THEN 0.0 ELSE 1.0 END, 6) FROM {MISSING} WHERE value IS NULL")
def row_distance_events(t):
    d = distance.row_distance([(F.col("value"), F.lit(100.0)), (F.col("event_type"), F.lit("click"))], [False, True], [0.01, 1.0])
    return r6(events_missing(t).select("event_id", d.alias("d")))


_RATE = "(SELECT o_custkey AS u, l_partkey AS i, avg(l_quantity) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def ratings(t) -> DataFrame:
    """Mean quantity of each customer's lines of each part, over all orders."""
    x = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.groupBy(F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("item")).agg(F.avg("l_quantity").alias("rating"))


def triples(t) -> DataFrame:
    return ratings(t).select(F.col("user").alias("row"), F.col("item").alias("key"), F.col("rating").alias("value"))


@query(f"WITH t AS {_RATE} SELECT CAST(a.u AS INT) AS a_row, CAST(b.u AS INT) AS b_row, round(sum(a.r * b.r) / sqrt(sum(a.r * a.r) * sum(b.r * b.r)), 6) AS similarity, count(*) AS shared FROM t a JOIN t b USING (i) GROUP BY 1, 2")
def sparse_cosine_ratings(t):
    x = triples(t)
    return r6(distance.sparse_similarity(x, x, "cosine"))


@query(f"WITH t AS {_RATE} SELECT CAST(a.u AS INT) AS a_row, CAST(b.u AS INT) AS b_row, CASE WHEN sum(power(a.r - b.r, 2)) > 0 THEN round(1 / sum(power(a.r - b.r, 2)), 9) ELSE 1e12 END AS similarity, count(*) AS shared FROM t a JOIN t b USING (i) GROUP BY 1, 2")
def sparse_euclid_ratings(t):
    x = triples(t)
    return r6(distance.sparse_similarity(x, x, "euclid"), 9)


# ---- clustering -------------------------------------------------------------------------------------

_CENT = [[10.0, 20000.0], [25.0, 40000.0], [40.0, 60000.0]]
_DIST = [f"power(l_quantity - {a}, 2) + power(l_extendedprice - {b}, 2)" for a, b in _CENT]


@query(f"WITH a AS (SELECT *, {_DIST[0]} AS d0, {_DIST[1]} AS d1, {_DIST[2]} AS d2 FROM lineitem) SELECT CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster, count(*) AS n, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice FROM a GROUP BY 1")
def centroid_step_lineitem(t):
    x = cluster.centroid_step(t("lineitem"), ["l_quantity", "l_extendedprice"], _CENT).select("cluster", "n", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"))
    return x


@query("WITH d AS (SELECT s_acctbal AS x, power(greatest(abs(s_acctbal), 1e-6), -2 / 0.3) AS w0, power(greatest(abs(s_acctbal - 5000), 1e-6), -2 / 0.3) AS w1 FROM supplier), m AS (SELECT x, w0 / (w0 + w1) AS w0, w1 / (w0 + w1) AS w1 FROM d) SELECT 0 AS cluster, round(sum(w0), 6) AS weight, round(sum(x * w0) / sum(w0), 4) AS s_acctbal FROM m UNION ALL SELECT 1, round(sum(w1), 6), round(sum(x * w1) / sum(w1), 4) FROM m")
def fuzzy_step_suppliers(t):
    x = cluster.fuzzy_step(t("supplier"), ["s_acctbal"], [[0.0], [5000.0]], 1.3)
    return x.select("cluster", F.round("weight", 6).alias("weight"), F.round("s_acctbal", 4).alias("s_acctbal"))


@query()
def k_means_lineitem(t):
    return cluster.k_means(columns.normalize(t("lineitem").select(*LINE), cols=["l_quantity", "l_extendedprice"]), ["l_quantity", "l_extendedprice"], 4)[0].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query()
def k_medoids_suppliers(t):
    return cluster.k_medoids(t("supplier"), "s_suppkey", ["s_acctbal"], 3)[0].select("s_suppkey", "cluster")


@query()
def single_linkage_suppliers(t):
    return cluster.single_linkage(t("supplier"), "s_suppkey", ["s_acctbal"], 5)


@query()
def neighbour_transduction_suppliers(t):
    x = t("supplier").select("s_suppkey", "s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.when(F.col("s_acctbal") > 4000, "rich").otherwise("poor")).alias("label"))
    return cluster.neighbour_transduction(x, "s_suppkey", ["s_acctbal"], "label")


# ---- learners and evaluation ------------------------------------------------------------------------


def labelled(t) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id")
    return d.select("doc_id", "lang", "source", F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 4000, "middle").otherwise("long").alias("size"), F.col("quality").cast("string").alias("label"), "n_chars", "toxic")


_LAB = "(SELECT doc_id, lang, source, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 4000 THEN 'middle' ELSE 'long' END AS size, CAST(quality AS VARCHAR) AS label, n_chars, toxic FROM documents JOIN labels USING (doc_id))"
_NB = lambda f: f"ln((coalesce((SELECT count(*) FROM l b WHERE b.label = c.label AND b.{f} = l.{f}), 0) + 0.5 / (SELECT count(DISTINCT {f}) FROM l)) / (0.5 + c.n))"


@query(f"WITH l AS {_LAB}, c AS (SELECT label, count(*) AS n FROM l GROUP BY 1), s AS (SELECT l.doc_id, c.label, ln(c.n) + {_NB('lang')} + {_NB('source')} + {_NB('size')} AS s FROM l, c) SELECT doc_id, (array_agg(label ORDER BY round(s, 9) DESC, label))[1] AS prediction FROM s GROUP BY 1")
def naive_bayes_documents(t):
    x = labelled(t)
    return learners.NaiveBayes(["lang", "source", "size"], "label").fit(x).predict(x).select("doc_id", "prediction")


@query(f"WITH l AS {_LAB} SELECT doc_id, (SELECT (array_agg(label ORDER BY n DESC, label))[1] FROM (SELECT label, count(*) AS n FROM l GROUP BY 1)) AS prediction FROM l")
def baseline_learner_documents(t):
    x = labelled(t)
    return learners.Baseline(["lang"], "label").fit(x).predict(x).select("doc_id", "prediction")


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS bias, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope FROM lineitem")
def linear_regression_lineitem(t):
    m = learners.LinearRegression(["l_quantity"], "l_extendedprice").fit(t("lineitem")).model
    return t("region").sparkSession.createDataFrame([(round(m["bias"], 3), round(m["weights"][0], 3))], "bias double, slope double")


@query("SELECT label AS target, CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS predicted, count(*) AS n FROM " + _LAB + " GROUP BY 1, 2")
def confusion_documents(t):
    x = labelled(t).withColumn("p", F.when(F.col("n_chars") > 1500, "1").otherwise("0"))
    return evaluate.confusion(x, "label", "p")


@query("SELECT round(sum(power(l_quantity - 25, 2)), 3) AS sum_squared, round(sum(abs(l_quantity - 25)), 3) AS sum_absolute, count(*) AS n FROM lineitem")
def sum_errors_lineitem(t):
    return r6(evaluate.sum_errors(t("lineitem").withColumn("p", F.lit(25.0)), "l_quantity", "p"), 3)


@query(f"WITH s AS (SELECT n_chars AS score, count(*) AS n, sum(toxic) AS r FROM {_LAB} GROUP BY 1) SELECT score, round(sum(r) OVER w / sum(n) OVER w, 9) AS precision, round(sum(r) OVER w / (SELECT sum(r) FROM s), 9) AS recall FROM s WINDOW w AS (ORDER BY score DESC)")
def precision_recall_documents(t):
    return r6(evaluate.precision_recall(labelled(t), "n_chars", "toxic"), 9)


@query(f"WITH s AS (SELECT n_chars AS score, count(*) AS n, sum(toxic) AS r FROM {_LAB} GROUP BY 1) SELECT score, round(sum(r) OVER w / (SELECT sum(r) FROM s), 9) AS true_positive, round(sum(n - r) OVER w / (SELECT sum(n - r) FROM s), 9) AS false_positive FROM s WINDOW w AS (ORDER BY score DESC)")
def roc_documents(t):
    return r6(evaluate.roc(labelled(t), "n_chars", "toxic"), 9)


@query(f"WITH x AS (SELECT n_chars AS s, toxic AS y FROM {_LAB}), p AS (SELECT sum(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0 END) AS w FROM x a, x b WHERE a.y = 1 AND b.y = 0) SELECT round(w / ((SELECT count(*) FROM x WHERE y = 1) * (SELECT count(*) FROM x WHERE y = 0)), 9) AS auc FROM p")
def auc_documents(t):
    return r6(evaluate.auc(labelled(t), "n_chars", "toxic"), 9)


@query("SELECT max(o_orderkey) AS o_orderkey, o_orderstatus, o_orderpriority, arg_max(o_custkey, o_orderkey) AS prediction FROM orders GROUP BY 2, 3")
def instance_table_orders(t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey")
    m = learners.InstanceTable(["o_orderstatus", "o_orderpriority"], "o_custkey", key="o_orderkey").fit(o)
    return m.predict(o.groupBy("o_orderstatus", "o_orderpriority").agg(F.max("o_orderkey").alias("o_orderkey"))).select("o_orderkey", "o_orderstatus", "o_orderpriority", "prediction")


@query()
def knn_documents(t):
    x = labelled(t).withColumn("n_chars", F.col("n_chars").cast("double"))
    return learners.KNN(["n_chars"], "label", key="doc_id", k=5).fit(x).predict(x).select("doc_id", "prediction")


@query()
def decision_tree_documents(t):
    x = labelled(t)
    return learners.SparkML(["lang", "size", "n_chars"], "label", kind="tree", maxDepth=4).fit(x).predict(x).select("doc_id", "prediction")


@query()
def random_forest_documents(t):
    x = labelled(t)
    return learners.SparkML(["lang", "size", "n_chars"], "label", kind="forest", numTrees=8, seed=1).fit(x).predict(x).select("doc_id", "prediction")


@query()
def bag_documents(t):
    x = labelled(t)
    return learners.Bag(lambda i: learners.NaiveBayes(["lang", "size"], "label"), 3, ["lang", "size"], "label").fit(x).predict(x).select("doc_id", "prediction")


@query()
def ada_boost_documents(t):
    x = labelled(t)
    return learners.AdaBoost(lambda i: learners.NaiveBayes(["lang", "size"], "label"), 3, ["lang", "size"], "label", key="doc_id").fit(x).predict(x).select("doc_id", "prediction")


@query()
def mean_margins_documents(t):
    x = labelled(t).withColumn("n_chars", F.col("n_chars").cast("double")).withColumn("toxic", F.col("toxic").cast("double"))
    return learners.MeanMarginsTree(["n_chars", "toxic"], "label", depth=3).fit(x).predict(x).select("doc_id", "prediction")


@query()
def gaussian_process_suppliers(t):
    x = t("supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("n"), "s_acctbal")
    return learners.GaussianProcess(["n"], "s_acctbal", max_samples=200).fit(x).predict(x).select("s_suppkey", "prediction")


@query()
def cross_validate_documents(t):
    x = labelled(t)
    e = learners.repeat_validate(lambda: learners.NaiveBayes(["lang", "size"], "label"), x, "label", ["doc_id"], 2, 2)
    return t("region").sparkSession.createDataFrame(list(enumerate(e)), "rep int, error double")


# ---- recommenders -----------------------------------------------------------------------------------


@query(f"WITH t AS {_RATE} SELECT CAST(u AS INT) AS \"user\", CAST(i AS INT) AS item, round(m, 6) AS prediction FROM (SELECT DISTINCT u FROM t) a, (SELECT i, avg(r) AS m FROM t GROUP BY 1) b")
def recommend_baseline(t):
    return recommend.predict_baseline_all(ratings(t), 6)


@query(f"WITH t AS {_RATE}, s AS (SELECT a.u AS u, b.u AS o, least(greatest(sum(a.r * b.r) / sqrt(sum(a.r * a.r) * sum(b.r * b.r)), 0), 1) AS w FROM t a JOIN t b USING (i) WHERE a.u <> b.u GROUP BY 1, 2), c AS (SELECT t.u, t.i, s.w, b.r, row_number() OVER (PARTITION BY t.u, t.i ORDER BY s.w DESC, s.o) AS k FROM t JOIN s ON s.u = t.u JOIN t b ON b.u = s.o AND b.i = t.i), p AS (SELECT u, i, sum(w * r) / sum(w) AS p FROM c WHERE k <= 10 GROUP BY 1, 2), m AS (SELECT i, avg(r) AS m FROM t GROUP BY 1) SELECT CAST(t.u AS INT) AS \"user\", CAST(t.i AS INT) AS item, round(coalesce(p, m), 6) AS prediction FROM t JOIN m USING (i) LEFT JOIN p ON p.u = t.u AND p.i = t.i")
def recommend_users(t):
    return r6(recommend.predict_users_rated(ratings(t), 10))


@query()
def recommend_factorization(t):
    r = ratings(t)
    return recommend.MatrixFactorization(rank=4, rounds=5).fit(r).predict(r.select("user", "item"))


@query()
def recommend_clusters(t):
    r = ratings(t)
    c = cluster.sparse_k_means(triples(t), 3).select(F.col("row").alias("user"), "cluster")
    return recommend.predict_clusters(r, r.select("user", "item"), c)


# ---- texts as sparse vectors ------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = f"(SELECT doc, word, count(*) AS n FROM (SELECT doc_id AS doc, lower(left(unnest(regexp_extract_all(text, '[A-Za-z]+')), 63)) AS word FROM documents) WHERE length(word) >= 4 AND word NOT IN ({_STOP}) GROUP BY 1, 2)"


@query(f"SELECT word, count(*) AS docs, max(n) AS max_count, round(ln((SELECT count(*) FROM documents) / count(*)) / max(n), 9) AS weight FROM {_WORDS} GROUP BY 1")
def word_stats_documents(t):
    d = t("documents")
    return r6(sparse.word_stats(sparse.doc_words(d, "doc_id", "text", stemmed=False), d.count()), 9)


@query(f"WITH c AS {_WORDS}, w AS (SELECT word, ln((SELECT count(*) FROM documents) / count(*)) / max(n) AS w FROM c GROUP BY 1) SELECT doc, count(*) AS words, round(sum(n * w), 4) AS total FROM c JOIN w USING (word) GROUP BY 1")
def doc_vectors_documents(t):
    v = sparse.doc_vectors(t("documents"), "doc_id", "text", stemmed=False)
    return v.groupBy("doc").agg(F.count(F.lit(1)).alias("words"), F.round(F.sum("value"), 4).alias("total"))


@query()
def stemmed_vectors_documents(t):
    return sparse.doc_vectors(t("documents"), "doc_id", "text").groupBy("doc").agg(F.count(F.lit(1)).alias("words"), F.sum("value").alias("total"))


@query(f"WITH t AS {_RATE} SELECT CAST(i AS INT) AS \"row\", CAST(u AS INT) AS key, round(r, 9) AS value FROM t WHERE r <> 25")
def sparse_transpose_ratings(t):
    return r6(sparse.transpose(sparse.drop_default(triples(t), 25.0)), 9)


@query(f"WITH t AS {_RATE} SELECT CAST(u AS INT) - 100 AS \"row\", CAST(i AS INT) - 10 AS key, round(r, 9) AS value FROM t WHERE u BETWEEN 100 AND 599 AND i BETWEEN 10 AND 29")
def sub_matrix_ratings(t):
    return r6(sparse.sub_matrix(triples(t), 100, 10, 500, 20), 9)


# ---- graphs -----------------------------------------------------------------------------------------

_TRADE = "(SELECT c_nationkey AS s, s_nationkey AS d, 1000.0 / count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"


def trade(t) -> DataFrame:
    """Lines of all orders by customer's and supplier's nation; they are counted by supplier before the last join."""
    x = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy("c_nationkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n")).join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return x.groupBy(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).agg((F.lit(1000.0) / F.sum("n")).alias("cost"))


@query(f"WITH RECURSIVE e AS {_TRADE}, p(n, c, h) AS (SELECT 0, 0.0::DOUBLE, 0 UNION SELECT e.d, min(p.c + e.c), p.h + 1 FROM p JOIN e ON e.s = p.n WHERE p.h < 8 GROUP BY e.d, p.h) SELECT CAST(n AS BIGINT) AS node, round(min(c), 6) AS cost FROM p GROUP BY 1")
def shortest_paths_trade(t):
    return r6(graph.shortest_paths(trade(t), 0).select("node", "cost"))


@query(f"WITH e AS (SELECT CAST(s AS BIGINT) AS src, CAST(d AS BIGINT) AS dst, round(c, 6) AS cost FROM {_TRADE}) SELECT * FROM e WHERE src = 3 OR dst = 3")
def incident_trade(t):
    return r6(graph.incident(trade(t), 3))


@query("SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(min(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS component FROM nation")
def connected_nations(t):
    n = t("nation")
    e = n.alias("a").join(n.alias("b"), (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").cast("bigint").alias("src"), F.col("b.n_nationkey").cast("bigint").alias("dst"))
    return graph.connected(e, n.select(F.col("n_nationkey").alias("node")))


# paths of h edges from a to b: those of the least h are the shortest ones, and no shortest path has more than 24 edges
@query(f"""WITH RECURSIVE e AS (SELECT s, d FROM {_TRADE} WHERE c < 900), n AS (SELECT s AS v FROM e UNION SELECT d FROM e),
w(a, b, h, k) AS (SELECT v, v, 0, 1.0::DOUBLE FROM n UNION ALL SELECT w.a, e.d, w.h + 1, sum(w.k) FROM w JOIN e ON e.s = w.b WHERE w.h < 24 GROUP BY w.a, e.d, w.h + 1),
p AS (SELECT a, b, min(h) AS h, arg_min(k, h) AS k FROM w GROUP BY a, b),
r AS (SELECT DISTINCT b FROM p WHERE a <> b),
x AS (SELECT l.b AS v, sum(l.k * g.k / q.k) AS y FROM p l JOIN p g ON g.a = l.b JOIN p q ON q.a = l.a AND q.b = g.b
      WHERE l.a <> l.b AND g.a <> g.b AND q.a <> q.b AND l.h + g.h = q.h GROUP BY l.b)
SELECT CAST(r.b AS BIGINT) AS node, round(coalesce(y, 0), 6) AS betweenness FROM r LEFT JOIN x ON x.v = r.b""")
def betweenness_trade(t):
    return r6(graph.betweenness(trade(t).filter("cost < 900"), 25)[0])


@query(f"""WITH RECURSIVE e AS {_TRADE}, p(a, b, c, h) AS (SELECT n_nationkey, n_nationkey, 0.0::DOUBLE, 0 FROM nation
  UNION ALL SELECT p.a, e.d, min(p.c + e.c), p.h + 1 FROM p JOIN e ON e.s = p.b WHERE p.h < 24 GROUP BY p.a, e.d, p.h + 1)
SELECT CAST(a AS INTEGER) AS src, CAST(b AS INTEGER) AS dst, round(min(c), 6) AS cost FROM p GROUP BY a, b""")
def all_pairs_trade(t):
    d, _ = graph.all_pairs(trade(t), 25)
    return r6(t("region").sparkSession.createDataFrame([(i, j, float(d[i, j])) for i in range(25) for j in range(25) if np.isfinite(d[i, j])], "src int, dst int, cost double"))


# ---- sequences --------------------------------------------------------------------------------------


def event_sequences(t) -> DataFrame:
    codes = F.create_map(*[x for i, v in enumerate(("click", "view", "purchase", "login", "logout")) for x in (F.lit(v), F.lit(i))])
    e = t("events").select("user_id", "ts", F.coalesce(codes[F.col("event_type")], F.lit(4)).alias("o"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "o"))), lambda x: x["o"]).alias("seq"))


@query()
def hmm_events(t):
    m = sequence.HMM([0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [[0.3, 0.3, 0.2, 0.1, 0.1], [0.1, 0.1, 0.2, 0.3, 0.3]])
    return sequence.hmm_columns(event_sequences(t), "seq", sequence.baum_welch(event_sequences(t), "seq", m, 2)).drop("seq")


@query("""WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
f AS (SELECT user_id, event_id, value, i, coalesce(value, 0) AS level, CASE WHEN value IS NULL THEN 1e6 ELSE 100.0 END::DOUBLE AS level_var FROM x WHERE i = 1
  UNION ALL SELECT x.user_id, x.event_id, x.value, x.i, CASE WHEN x.value IS NULL THEN f.level ELSE f.level + (f.level_var + 1) / (f.level_var + 101) * (x.value - f.level) END,
         CASE WHEN x.value IS NULL THEN f.level_var + 1 ELSE (1 - (f.level_var + 1) / (f.level_var + 101)) * (f.level_var + 1) END FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1)
SELECT user_id, event_id, round(value, 6) AS value, round(level, 6) AS level, round(level_var, 6) AS level_var FROM f""")
def level_filter_events(t):
    return r6(sequence.level_filter(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 1.0, 100.0))


@query("""WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS x FROM events WHERE value IS NOT NULL GROUP BY 1),
k AS (SELECT user_id, x, unnest(range(0, len(x) // 2 + 1)) AS k FROM s),
m AS (SELECT user_id, k, sqrt(power(list_sum(list_transform(x, lambda v, i: v * cos(2 * pi() * k * (i - 1) / len(x)))), 2) + power(list_sum(list_transform(x, lambda v, i: v * sin(2 * pi() * k * (i - 1) / len(x)))), 2)) AS m FROM k),
l AS (SELECT user_id, list(m ORDER BY k) AS m FROM m GROUP BY 1),
b AS (SELECT user_id, m, len(m) // 4 AS w, len(m) % 4 AS o FROM l)
SELECT user_id, list_transform(m, lambda v: round(v, 4)) AS magnitude,
  list_transform([0, 1, 2, 3], lambda j: round(coalesce(list_avg(list_slice(m, j * w + least(j, o) + 1, (j + 1) * w + least(j + 1, o))), 0), 4)) AS bands FROM b""")
def fft_events(t):
    s = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("event_id", "value")))), lambda x: x["value"]).alias("x"))
    near = lambda c, name: F.transform(c, lambda v: F.round(v, 4)).alias(name)
    return s.select("user_id", near(sequence.fft_magnitude(F.col("x")), "magnitude"), near(sequence.spectrum(F.col("x"), 4), "bands"))


@query("SELECT i, round(0.5 * sin(i * 2 * pi() * 440 / 8000), 9) AS x FROM range(80) r(i)")
def sine_samples(t):
    x = t("region").limit(1).select(F.posexplode(sequence.sine(0.01, 8000, 440, 0.5)).alias("i", "x"))
    return r6(x.select(F.col("i").cast("bigint").alias("i"), "x"), 9)


# ---- distributions, generators, manifold ------------------------------------------------------------


@query("SELECT event_id, round(-power(value - 100, 2) / 5000 - 0.5 * ln(2 * pi() * 2500), 9) AS normal, round(CASE WHEN value > 0 THEN ln(value) - value / 50 - (lgamma(2) + 2 * ln(50)) END, 9) AS gamma FROM events")
def log_densities_events(t):
    return r6(t("events").select("event_id", distributions.normal_log(F.col("value"), 100, 2500).alias("normal"), distributions.gamma_log(F.col("value"), 2.0, 50.0).alias("gamma")), 9)


@query("SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS logistic, round(greatest(user_id - 50, 0), 6) AS rectifier, round(tanh(value / 100), 9) AS tanh FROM events")
def activations_events(t):
    a = distributions.ACTIVATIONS
    return r6(t("events").select("event_id", a["logistic"](F.col("value") / 100).alias("logistic"), a["rectifier"](F.col("user_id") - 50.0).alias("rectifier"), a["tanh"](F.col("value") / 100).alias("tanh")), 9)


@query()
def sample_categorical_nations(t):
    return distributions.sample_categorical(t("nation").withColumn("w", F.col("n_nationkey") + 1.0), "n_nationkey", "w", 500, 1)


@query()
def noise_gaussian(t):
    return distributions.noise(t("region").sparkSession, 1000, "gaussian", 1, mean=3, dev=2)


@query("SELECT i / 49.0 AS x, round(power(i / 49.0, 2), 9) AS f1 FROM range(50) r(i)")
def equation_table(t):
    return generate.equation_table(t("region").sparkSession, "f1(x)=x^2", 0.0, 1.0, 49).select(F.col("x").alias("x"), F.round("f1", 9).alias("f1"))


@query()
def swiss_roll(t):
    return generate.swiss_roll(t("region").sparkSession, 1000)


@query()
def random_walk(t):
    return generate.random_walk(t("region").sparkSession, 1000)


@query()
def isomap_swiss_roll(t):
    x = generate.swiss_roll(t("region").sparkSession, 200, 1)
    return manifold.isomap(x, "id", ["x", "y", "z"], 8, 2, tolerant=True)


@query()
def multidimensional_scaling_nations(t):
    p = t("supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("b")).orderBy("s_nationkey").toPandas()
    y = manifold.multidimensional_scaling(np.abs(p["b"].to_numpy()[:, None] - p["b"].to_numpy()[None]), 1)
    return t("region").sparkSession.createDataFrame([(int(k), float(v[0])) for k, v in zip(p["s_nationkey"], y)], "nation int, y double")


# ---- event time -------------------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2, 3")
def windowed_events(t):
    x = online.windowed(t("events"), "ts", "1 day", "1 hour", ["event_type"], "value")
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "n", F.round("total", 3).alias("total"))


@query("WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g) SELECT min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, user_id, count(*) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, s")
def sessions_events(t):
    x = online.sessions(t("events"), "ts", "6 hours", "1 hour", ["user_id"], "value")
    return x.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "user_id", "n", F.round("total", 3).alias("total"))
