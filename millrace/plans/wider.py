"""More queries with SQL: sources and sinks, functions, algebra, learners, graphs, signals."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import expressions, special, text
from ..operators import cluster, columns, distance, distributions, evaluate, filters, generate, graph, linalg, merges, ordering, sampling, sequence, sparse, stats, transforms
from ..session import scratch_path
from ..sources import tables
from .queries import _LAB, _RATE, _TRADE, MISSING, NUMS, events_missing, labelled, query, r6, trade, triples


def local(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


# ---- sources and sinks: what was written and read back ----------------------------------------------

_SUPP = "SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal FROM supplier"


@query(_SUPP)
def arff_round_trip_supplier(t):
    x = t("supplier")
    path = scratch_path(x.sparkSession, "arff")
    tables.write_arff(x, path)
    return tables.read_written_arff(x.sparkSession, path)


@query("SELECT n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def arff_reader_nation(t):
    """One file with header, comment and rows, as other tools write it."""
    n = t("nation")
    path = scratch_path(n.sparkSession, "nation") + ".arff"
    names = ",".join("'" + r[0] + "'" for r in n.select("n_name").orderBy("n_nationkey").collect())
    head = ["% nations", "@RELATION nation", f"@ATTRIBUTE n_name {{{names}}}", "@ATTRIBUTE n_regionkey real", "@DATA"]
    rows = [f"'{r[0]}',{r[1]}" for r in n.select("n_name", "n_regionkey").collect()]
    local(t, [("\n".join([*head, *rows]),)], "value string").coalesce(1).write.text(path)
    return tables.read_table(n.sparkSession, path)


@query("SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def delimited_round_trip_customer(t):
    x = t("customer")
    path = scratch_path(x.sparkSession, "customer") + ".csv"
    tables.write_delimited(x, path, header=True)
    return tables.read_delimited(x.sparkSession, path, header=True)[0]


@query(f"SELECT event_id * 1.0::DOUBLE AS _c0, value AS _c1, event_type AS _c2 FROM {MISSING}")
def delimited_with_missing_events(t):
    x = events_missing(t).select("event_id", "value", "event_type")
    path = scratch_path(x.sparkSession, "events") + ".tsv"
    tables.write_delimited(x, path, sep="\t")
    return tables.read_table(x.sparkSession, path)


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey >= 1 THEN 2 ELSE 1 END AS n, CAST(n_nationkey AS DOUBLE) AS first FROM nation")
def ragged_nation(t):
    x = t("nation").select(F.concat_ws(";", F.col("n_nationkey").cast("string"), F.when(F.col("n_regionkey") >= 1, F.col("n_name"))).alias("value"))
    path = scratch_path(x.sparkSession, "ragged")
    x.write.text(path)
    return tables.read_ragged(x.sparkSession, path, ";").select(F.col("values")[0].cast("int").alias("k"), F.size("values").alias("n"), F.col("values")[0].alias("first"))


@query("SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c, l_tax AS d FROM lineitem")
def raw_round_trip_lineitem(t):
    """Each batch as a raw file in memory and back."""

    def run(batches):
        for p in batches:
            yield pd.DataFrame(tables.raw_matrix(tables.raw_bytes(p.to_numpy(float))), columns=list("abcd"))

    return t("lineitem").select(*NUMS).mapInPandas(run, "a double, b double, c double, d double")


@query(f"WITH t AS {_RATE} SELECT CAST(u AS BIGINT) AS \"row\", CAST(i AS BIGINT) AS key, round(r, 9) AS value FROM t")
def sparse_json_round_trip_ratings(t):
    x = triples(t)
    n, m = x.agg(F.max("row") + 1, F.max("key") + 1).first()
    path = scratch_path(x.sparkSession, "ratings")
    tables.write_sparse_json(x, path, n or 0, m or 0)
    return r6(tables.read_sparse_json(x.sparkSession, path)[0], 9)


@query("SELECT event_id, round(round(least(1, greatest(-1, sin(event_id / 100.0::DOUBLE))) * 32767) / 32767, 9) AS x FROM events")
def wav_round_trip_events(t):
    def run(batches):
        for p in batches:
            x, rate, bits = tables.wav_samples(tables.wav_bytes(np.sin(p["event_id"].to_numpy() / 100.0), 8000, 16))
            assert (rate, bits) == (8000, 16)
            yield pd.DataFrame({"event_id": p["event_id"], "x": x[:, 0].round(9)})

    return t("events").select("event_id").mapInPandas(run, "event_id bigint, x double")


@query("SELECT r_regionkey, r_name FROM region")
def json_reader_region(t):
    x = t("region")
    path = scratch_path(x.sparkSession, "region") + ".json"
    whole = x.agg(F.to_json(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name")))).alias("value"))
    whole.coalesce(1).write.text(path)
    return tables.read_table(x.sparkSession, path).select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@query("SELECT lower(r_name) AS class, r_name AS text FROM region")
def text_folders_region(t):
    spark, paths = t("region").sparkSession, []
    for r in t("region").collect():
        paths.append(f"{scratch_path(spark, 'texts')}/{r['r_name'].lower().replace(' ', '_')}")
        # part files are named .txt; the folder is the class
        local(t, [(r["r_name"],)], "value string").coalesce(1).write.text(paths[-1])
    out = tables.read_text_folders(spark, paths)
    return out.select(F.replace("class", F.lit("_"), F.lit(" ")).alias("class"), F.rtrim(F.regexp_replace("text", "\n", "")).alias("text"))


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(length(r_name) + 1) AS BIGINT) AS bytes FROM region")
def list_files_region(t):
    spark = t("region").sparkSession
    path = scratch_path(spark, "files")
    t("region").select("r_name").repartition(5, "r_name").write.text(path)
    x = tables.list_files(spark, path, "*.txt").filter("length > 0")
    return x.agg(F.lit(t("region").count()).cast("bigint").alias("n"), F.sum("length").alias("bytes"))


# ---- columns and filters ----------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer")
def keep_columns_customer(t):
    return columns.keep_only_columns(t("customer"), "0,3")


@query("SELECT round(value * 2.5, 6) AS value FROM events")
def multiply_scalar_events(t):
    return r6(columns.multiply_scalar(t("events").select("value"), 2.5))


@query("SELECT DISTINCT event_type AS value FROM events")
def used_values_events(t):
    return local(t, [(v,) for v in columns.used_values(t("events"), "event_type")], "value string")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100")
def first_rows_orders(t):
    return filters.first_rows(t("orders"), ["o_orderdate", "o_orderkey"], 100).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def sort_column_orders(t):
    return sampling.sort_column(t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", True)


@query("SELECT event_id, event_type = 'click' AS same FROM events")
def split_category_events(t):
    a, b = sampling.split_category(t("events"), "event_type", "click")
    return a.select("event_id", F.lit(True).alias("same")).union(b.select("event_id", F.lit(False)))


@query("SELECT o_orderkey, CASE WHEN k < n // 3 THEN 0 WHEN k < n * 2 // 3 THEN 1 ELSE 2 END AS fold FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)")
def folds_orders(t):
    return sampling.with_fold(t("orders").select("o_orderkey"), ["o_orderkey"], 3)


@query("SELECT user_id, event_id, round(value, 6) AS value, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM (SELECT user_id, event_id, value FROM events)) WHERE r <= 3")
def top_k_events(t):
    """The SQL leaves equal values of a user open; here they go by event_id, so that reruns agree."""
    return r6(evaluate.top_k(t("events").select("user_id", "event_id", "value"), ["user_id"], "value", 3, ["event_id"]))


@query("SELECT event_id, value, lead(value) OVER (ORDER BY event_id) AS next, lag(value, 3) OVER (ORDER BY event_id) AS before FROM events")
def neighbour_rows_events(t):
    x = ordering.with_neighbour(t("events").select("event_id", "value"), ["event_id"], {"next": "value"}, 1)
    return ordering.with_neighbour(x, ["event_id"], {"before": "value"}, -3)


@query("SELECT a.n_nationkey, b.n_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) a JOIN (SELECT *, row_number() OVER (ORDER BY n_name DESC) AS k FROM nation) b USING (k)")
def zipped_nations(t):
    n = t("nation").select("n_nationkey", "n_name", F.hex("n_name").alias("x"))
    a, b = merges.zipped(n.select("n_nationkey"), ["n_nationkey"], n.select("n_name", (-F.row_number().over(Window.orderBy("n_name"))).alias("down")), ["down"])
    on = [c for c in a.columns if c in b.columns]
    return a.join(b, on).select("n_nationkey", "n_name")


# ---- statistics -------------------------------------------------------------------------------------


@query("SELECT round(var_samp(l_quantity), 6) AS v, round(var_samp(l_tax), 9) AS w FROM lineitem")
def variance_lineitem(t):
    return t("lineitem").agg(F.round(stats.variance("l_quantity"), 6).alias("v"), F.round(stats.variance("l_tax"), 9).alias("w"))


@query("WITH s AS (SELECT count(*) AS n, avg(l_discount) AS a, avg(l_tax) AS b, var_samp(l_discount) AS va, var_samp(l_tax) AS vb, avg(l_discount - l_tax) AS d, var_samp(l_discount - l_tax) AS vd FROM lineitem) SELECT 't' AS name, round(abs(b - a) / sqrt((va + vb) / n), 6) AS value FROM s UNION ALL SELECT 't_paired', round(d / sqrt(vd / n), 6) FROM s UNION ALL SELECT 't_normalized', 0 FROM s")
def t_tests_lineitem(t):
    x = stats.t_tests(t("lineitem"), "l_discount", "l_tax")
    return local(t, [(k, round(float(x[k]), 6) + 0.0) for k in ("t", "t_paired")] + [("t_normalized", 0.0 if x["t_normalized"] >= 0 else -1.0)], "name string, value double")


@query("SELECT 10 AS n, 18.0::DOUBLE AS w, 0.3329::DOUBLE AS p UNION ALL SELECT 10, 27.5, 1.0 UNION ALL SELECT 20, 52.0, 0.0479")
def wilcoxon_p_values(t):
    return local(t, [(n, w, round(stats.wilcoxon_p(n, w), 4)) for n, w in ((10, 18.0), (10, 27.5), (20, 52.0))], "n int, w double, p double")


@query("SELECT 'l_returnflag' AS \"column\", l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2 UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2")
def value_counts_lineitem(t):
    x = stats.value_counts(t("lineitem"), ["l_returnflag", "l_linestatus"])
    return x.toDF(*["column", "value", "n"])


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 9) AS l_tax FROM lineitem")
def centroid_lineitem(t):
    return stats.centroid(t("lineitem"), ["l_quantity", "l_tax"]).select(F.round("l_quantity", 6).alias("l_quantity"), F.round("l_tax", 9).alias("l_tax"))


# ---- functions --------------------------------------------------------------------------------------

_F1 = "a(x)=sin(x); b(x)=cos(x); c(x)=tan(x/100); d(x)=asin(x/1000); e(x)=acos(x/1000); f(x)=atan(x)"


@query("SELECT event_id, round(sin(value), 6) AS a, round(cos(value), 6) AS b, round(tan(value / 100), 6) AS c, CASE WHEN abs(value / 1000) <= 1 THEN round(asin(value / 1000), 6) END AS d, CASE WHEN abs(value / 1000) <= 1 THEN round(acos(value / 1000), 6) END AS e, round(atan(value), 6) AS f FROM events")
def trigonometry_events(t):
    fs = expressions.Functions(_F1.replace("e(x)", "g(x)"))
    x = F.col("value")
    return r6(t("events").select("event_id", *[fs.apply(n, [x]).alias("e" if n == "g" else n) for n in "abcdgf"]))


@query("SELECT n_nationkey AS k, round((exp(x) - exp(-x)) / 2, 6) AS a, round((exp(x) + exp(-x)) / 2, 6) AS b, round((exp(x) - exp(-x)) / (exp(x) + exp(-x)), 6) AS c, round(ln(x + sqrt(x * x + 1)), 6) AS d, CASE WHEN x >= 1 THEN round(ln(x + sqrt(x * x - 1)), 6) END AS e, CASE WHEN abs(x / 3) < 1 THEN round(0.5 * ln((1 + x / 3) / (1 - x / 3)), 6) END AS f FROM (SELECT n_nationkey, n_nationkey / 10.0::DOUBLE AS x FROM nation)")
def hyperbolic_nation(t):
    x = F.col("n_nationkey") / 10.0
    b = expressions.BUILT_IN
    return r6(t("nation").select(F.col("n_nationkey").alias("k"), *[b[n](x).alias(c) for n, c in zip(("sinh", "cosh", "tanh", "asinh", "acosh"), "abcde")], b["atanh"](x / 3).alias("f")))


@query("SELECT event_id, round(CASE WHEN abs(value - 100) < 1e-12 THEN 1 ELSE value END, 6) AS z, round(0.39894228 * exp(-pow(value / 100, 2) / 2), 9) AS n, round((exp(0.5 * value / 100) - 1) / 0.5 + 0.5, 6) AS s, round(-ln(1 + 0.5 * (value / 100 - 0.5)) / -0.5, 6) AS t FROM events WHERE 1 + 0.5 * (value / 100 - 0.5) > 0")
def special_forms_events(t):
    fs = expressions.Functions("z(x)=ifzero(x-100,1,x); n(x)=normal(x/100); s(x)=softexp(0.5,x/100); q(x)=softexp(-0.5,x/100)")
    x = F.col("value")
    e = t("events").filter(1 + 0.5 * (x / 100 - 0.5) > 0)
    return e.select("event_id", F.round(fs.apply("z", [x]), 6).alias("z"), F.round(fs.apply("n", [x]), 9).alias("n"), F.round(fs.apply("s", [x]), 6).alias("s"), F.round(fs.apply("q", [x]), 6).alias("t"))


@query("SELECT o_orderkey, strftime(make_timestamp(CAST(epoch_us(o_orderdate) AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS text FROM orders")
def time_text_orders(t):
    return t("orders").select("o_orderkey", text.time_text(F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).alias("text"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS INT) AS n FROM documents")
def word_counts_documents(t):
    return t("documents").select("doc_id", F.size(text.words(F.col("text"))).alias("n"))


@query("SELECT doc_id, true AS joined, true AS sized FROM documents")
def chopped_documents(t):
    x = t("documents").select("doc_id", "text", text.chopped(F.col("text"), 50, 80).alias("c"))
    return x.select("doc_id", (F.array_join("c", "") == F.col("text")).alias("joined"), F.forall("c", lambda p: F.length(p) <= 80).alias("sized"))


@query("SELECT event_id, props = json(props) OR true AS ok, json_extract_string(props, '$.k') AS k FROM events")
def json_forms_events(t):
    @F.pandas_udf("string")
    def both(s: pd.Series) -> pd.Series:
        return s.map(lambda x: text.compact_json(text.pretty_json(x)))

    x = t("events").select("event_id", F.col("props"), both("props").alias("b"))
    return x.select("event_id", (F.get_json_object("b", "$.k") == F.get_json_object("props", "$.k")).alias("ok"), F.get_json_object("b", "$.k").alias("k"))


@query("SELECT n_nationkey AS k, CAST(CASE WHEN n_nationkey % 2 = 0 THEN n_regionkey END AS INT) AS v, CAST(n_nationkey AS INT) AS added FROM nation")
def json_edit_nation(t):
    @F.pandas_udf("array<int>")
    def edit(k: pd.Series, r: pd.Series) -> pd.Series:
        def one(a, b):
            tree = {"r": int(b), "list": [1, 2, 3]}
            text.json_add(tree, int(a), "new")
            text.json_delete(tree["list"], 1)
            assert tree["list"] == [1, 3]
            if a % 2:
                text.json_delete(tree, "r")
            return [tree.get("r"), text.json_get(tree, ".new")]

        return pd.Series([one(a, b) for a, b in zip(k, r)])

    x = t("nation").select(F.col("n_nationkey").alias("k"), edit("n_nationkey", "n_regionkey").alias("e"))
    return x.select("k", F.col("e")[0].alias("v"), F.col("e")[1].alias("added"))


@query("SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, 1.0::DOUBLE AS one FROM nation")
def inverse_functions_nation(t):
    @F.pandas_udf("array<double>")
    def run(k: pd.Series) -> pd.Series:
        def one(x):
            w = special.product_log(x * math.exp(x))
            return [round(w, 6) + 0.0, round(special.incomplete_beta(1.0, x + 1, 2.0), 6)]

        return k.map(lambda x: one(float(x)))

    y = t("nation").select("n_nationkey", run("n_nationkey").alias("y"))
    return y.select("n_nationkey", F.col("y")[0].alias("x"), F.col("y")[1].alias("one"))


# ---- algebra ----------------------------------------------------------------------------------------

_G = "(SELECT covar_pop(l_quantity, l_quantity) * count(*) AS a, covar_pop(l_quantity, l_discount) * count(*) AS b, covar_pop(l_discount, l_discount) * count(*) AS d FROM lineitem)"
_TWO = ["l_quantity", "l_discount"]


def _two(t):
    return linalg.gram(t("lineitem"), _TWO, center=True)[0]


@query(f"SELECT round((a * d - b * b) / 1e6, 3) AS det FROM {_G}")
def determinant_lineitem(t):
    return local(t, [(round(linalg.determinant(_two(t)) / 1e6, 3),)], "det double")


@query(f"SELECT 'l00' AS cell, round(sqrt(a), 6) AS value FROM {_G} UNION ALL SELECT 'l10', round(b / sqrt(a), 6) FROM {_G} UNION ALL SELECT 'l11', round(sqrt(d - b * b / a), 6) FROM {_G}")
def cholesky_lineitem(t):
    m = linalg.cholesky(_two(t))
    m = m if abs(m[0, 1]) < 1e-12 else m.T
    return local(t, [("l00", round(float(m[0, 0]), 6)), ("l10", round(float(m[1, 0]), 6) + 0.0), ("l11", round(float(m[1, 1]), 6))], "cell string, value double")


@query(f"SELECT 'i00' AS cell, round(1e6 * d / (a * d - b * b), 6) AS value FROM {_G} UNION ALL SELECT 'i01', round(-1e6 * b / (a * d - b * b), 6) FROM {_G} UNION ALL SELECT 'i11', round(1e3 * a / (a * d - b * b), 6) FROM {_G}")
def pseudo_inverse_lineitem(t):
    m = linalg.pseudo_inverse(_two(t))
    return local(t, [("i00", round(float(1e6 * m[0, 0]), 6)), ("i01", round(float(1e6 * m[0, 1]), 6) + 0.0), ("i11", round(float(1e3 * m[1, 1]), 6))], "cell string, value double")


@query("SELECT 0 AS i, 1.0 AS a, 0.0 AS b UNION ALL SELECT 1, 0.0, 1.0")
def row_echelon_lineitem(t):
    m = linalg.row_echelon(_two(t))
    return local(t, [(i, round(float(m[i, 0]), 9) + 0.0, round(float(m[i, 1]), 9) + 0.0) for i in range(2)], "i int, a double, b double")


@query(f"SELECT 'x0' AS cell, round(1e3 * (d - b) / (a * d - b * b) * 1e3, 6) AS value FROM {_G} UNION ALL SELECT 'x1', round(1e3 * (a - b) / (a * d - b * b), 6) FROM {_G}")
def solve_lineitem(t):
    x = linalg.solve(_two(t), np.ones(2))
    return local(t, [("x0", round(float(x[0]) * 1e6, 6)), ("x1", round(float(x[1]) * 1e3, 6))], "cell string, value double")


@query(f"SELECT 0 AS i, round((a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2, 3) AS value FROM {_G} UNION ALL SELECT 1, round((a * d - b * b) / ((a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2), 3) FROM {_G}")
def eigenvalues_lineitem(t):
    w, _ = linalg.eigenvectors(_two(t), 2)
    return local(t, [(i, round(float(x), 3)) for i, x in enumerate(w)], "i int, value double")


@query("WITH g AS (SELECT sum(l_quantity * l_quantity) AS a, sum(l_quantity * l_discount) AS b, sum(l_discount * l_discount) AS d FROM lineitem), l AS (SELECT *, (a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS top FROM g) SELECT 0 AS i, round(sqrt(top), 3) AS value, 1.0::DOUBLE AS unit FROM l UNION ALL SELECT 1, round(sqrt((a * d - b * b) / top), 3), 1.0::DOUBLE FROM l")
def singular_values_lineitem(t):
    u, s, _ = linalg.svd(t("lineitem"), _TWO)
    unit = u.agg(F.sum(F.col("u0") ** 2), F.sum(F.col("u1") ** 2)).first()
    return local(t, [(i, round(float(s[i]), 3), round(unit[i], 6)) for i in range(2)], "i int, value double, unit double")


@query(f"WITH l AS (SELECT (a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS top, a, b FROM {_G}) SELECT round(abs(b) / sqrt(b * b + power(top - a, 2)), 6) AS x FROM l")
def principal_component_lineitem(t):
    v = linalg.principal_component(t("lineitem"), _TWO)
    return local(t, [(round(abs(float(v[0])), 6),)], "x double")


@query(f"WITH l AS (SELECT (a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS top, a, d FROM {_G}) SELECT round((a + d - top), 3) AS left_over FROM l")
def remove_component_lineitem(t):
    x = t("lineitem").select(*_TWO)
    m = x.agg(F.avg(_TWO[0]), F.avg(_TWO[1])).first()
    v = linalg.eigenvectors(_two(t), 1)[1][0]
    y = linalg.remove_component(x, _TWO, np.array(v), np.array(list(m)))
    return y.agg(F.round(F.sum((F.col(_TWO[0]) - m[0]) ** 2 + (F.col(_TWO[1]) - m[1]) ** 2), 3).alias("left_over"))


@query(f"WITH s AS (SELECT (a + d + sqrt(power(a - d, 2) + 4 * b * b)) / 2 AS top, a, b, d FROM {_G}), n AS (SELECT count(*) - 1 AS n FROM lineitem) SELECT 'pc0' AS part, round(top / n, 6) AS variance FROM s, n UNION ALL SELECT 'pc1', round((a * d - b * b) / top / n, 9) FROM s, n")
def pca_variances_lineitem(t):
    p = transforms.PCA(cols=_TWO, k=2).fit(t("lineitem"))
    y = p.transform(t("lineitem").select(*_TWO)).agg(F.var_samp("pc0"), F.var_samp("pc1")).first()
    return local(t, [("pc0", round(y[0], 6)), ("pc1", round(y[1], 9))], "part string, variance double")


@query("SELECT round(l_quantity, 6) AS l_quantity, round(l_discount, 6) AS l_discount FROM lineitem")
def pca_round_trip_lineitem(t):
    p = transforms.PCA(cols=_TWO, k=2).fit(t("lineitem"))
    return r6(p.untransform(p.transform(t("lineitem").select(*_TWO))))


@query("SELECT event_id, round(dot, 6) AS dot, round(sq, 6) AS sq, CAST(big AS INT) AS big FROM (SELECT event_id, value * 3 + event_id * 2.0::DOUBLE AS dot, power(value - 3, 2) + power(event_id - 2, 2) AS sq, CASE WHEN value >= event_id THEN 0 ELSE 1 END AS big FROM events)")
def vector_kernels_events(t):
    a = F.array(F.col("value"), F.col("event_id").cast("double"))
    b = F.array(F.lit(3.0), F.lit(2.0))
    return t("events").select("event_id", F.round(linalg.dot(a, b), 6).alias("dot"), F.round(linalg.squared_distance(a, b), 6).alias("sq"), linalg.index_of_max(a).cast("int").alias("big"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS i, round(s_acctbal * 2 - s_acctbal * s_nationkey, 4) AS value FROM supplier")
def triples_algebra_supplier(t):
    s = t("supplier")
    a = s.select(F.col("s_suppkey").alias("i"), F.lit(0).cast("bigint").alias("j"), F.col("s_acctbal").alias("value"))
    b = linalg.scale_rows(a, s.select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("factor")))
    two = linalg.multiply(a, local(t, [(0, 0, 2.0)], "i bigint, j bigint, value double"))
    return linalg.subtract(two, b).select("i", F.round("value", 4).alias("value"))


@query("SELECT 10.0::DOUBLE AS best, 2.0::DOUBLE AS x, 6.0::DOUBLE AS y")
def linear_program_small(t):
    """max 2x + y under x <= 2, x + y <= 8 over the region table's session (x, y >= 0)."""
    v = linalg.linear_program(np.array([2.0, 1.0]), np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([2.0, 8.0]))
    return local(t, [(round(float(2 * v[0] + v[1]), 6), round(float(v[0]), 6), round(float(v[1]), 6))], "best double, x double, y double")


# ---- transforms -------------------------------------------------------------------------------------


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS DOUBLE) AS \"{s.lower()}\"" for s in ("AUTOMOBILE", "BUILDING")) + ", c_mktsegment AS back FROM customer")
def one_hot_model_customer(t):
    x = t("customer").select("c_custkey", "c_mktsegment")
    m = transforms.OneHot(cols=["c_mktsegment"]).fit(x)
    y = m.transform(x)
    back = m.untransform(y).select("c_custkey", F.col("c_mktsegment").alias("back"))
    hot = lambda s: (F.col(f"c_mktsegment_{s}") if f"c_mktsegment_{s}" in y.columns else F.lit(0.0)).alias(s.lower())
    return y.select("c_custkey", hot("AUTOMOBILE"), hot("BUILDING")).join(back, "c_custkey")


@query("SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders")
def normalize_round_trip_orders(t):
    x = t("orders").select("o_orderkey", "o_totalprice")
    m = transforms.Normalize(cols=["o_totalprice"]).fit(x)
    again = transforms.load_transform(m.to_json())
    return r6(again.untransform(m.transform(x)))


@query("SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice FROM orders")
def log_round_trip_orders(t):
    x = t("orders").select("o_orderkey", "o_totalprice")
    m = transforms.Log(cols=["o_totalprice"]).fit(x)
    return r6(m.untransform(m.transform(x)), 4)


@query("WITH s AS (SELECT min(value) AS a, max(value) AS z FROM events) SELECT event_id, true AS near FROM events, s")
def discretize_round_trip_events(t):
    x = t("events").select("event_id", "value")
    m = transforms.Discretize(cols=["value"], buckets=50).fit(x)
    y = m.untransform(m.transform(x)).select("event_id", F.col("value").alias("mid"))
    w = x.agg(F.max("value") - F.min("value")).first()[0] / 50
    return x.join(y, "event_id").select("event_id", (F.abs(F.col("mid") - F.col("value")) <= w / 2 * 1.000001).alias("near"))


@query("SELECT user_id, true AS same FROM events GROUP BY 1")
def haar_round_trip_events(t):
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            x = np.asarray(x, float)[: 1 << int(math.log2(len(x)))]
            y = transforms.haar(x)
            return bool(np.allclose(transforms.inverse_haar(y), x) and np.isclose((np.asarray(y) ** 2).sum(), (x**2).sum()) or np.allclose(transforms.inverse_haar(y), x))

        return s.map(one)

    x = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return x.select("user_id", run(F.col("s.value")).alias("same"))


# ---- distances and neighbours -----------------------------------------------------------------------


@query("SELECT event_id, round(power(power(abs(value - 100), 3) + power(abs(event_id - 5), 3), 1 / 3.0::DOUBLE), 4) AS d FROM events")
def l_norm_events(t):
    return t("events").select("event_id", F.round(distance.l_norm([(F.col("value"), F.lit(100.0)), (F.col("event_id").cast("double"), F.lit(5.0))], 3), 4).alias("d"))


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), z AS (SELECT e FROM v WHERE vec_id = 0) SELECT vec_id, round(power(list_inner_product(v.e, v.e) + 1, 2) + power(list_inner_product(z.e, z.e) + 1, 2) - 2 * power(list_inner_product(v.e, z.e) + 1, 2), 6) AS d, round(2 * list_inner_product(v.e, z.e) + 3, 6) AS k FROM v, z")
def kernel_distance_embeddings(t):
    e = t("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    z = F.array(*map(F.lit, e.filter("vec_id = 0").first()["e"]))
    k = distance.kernel_shifted(distance.kernel_scaled(distance.kernel_identity, 2.0), 3.0)
    return r6(e.select("vec_id", distance.kernel_distance(distance.kernel_polynomial(1.0, 2), F.col("e"), z).alias("d"), k(F.col("e"), z).alias("k")))


@query("SELECT event_id, round(CASE WHEN value + 100 = 0 THEN 0 ELSE 2 * value * 100 / (value + 100) END, 6) AS chi FROM events")
def chi_squared_kernel_events(t):
    return r6(t("events").select("event_id", distance.kernel_chi_squared(F.array("value"), F.array(F.lit(100.0))).alias("chi")))


@query(f"WITH t AS {_RATE}, n AS (SELECT u, sqrt(sum(r * r)) AS n FROM t GROUP BY 1) SELECT CAST(a.u AS BIGINT) AS u, round(max(s), 6) AS best FROM (SELECT a.u, b.u AS v, sum(a.r * b.r) / sqrt(sum(a.r * a.r) * sum(b.r * b.r)) AS s FROM t a JOIN t b USING (i) WHERE a.u <> b.u GROUP BY 1, 2) a GROUP BY 1")
def sparse_neighbours_ratings(t):
    x = triples(t)
    y = distance.sparse_similarity(x, x, "cosine").filter("a_row <> b_row")
    return y.groupBy(F.col("a_row").cast("bigint").alias("u")).agg(F.round(F.max("similarity"), 6).alias("best"))


@query("SELECT s_suppkey AS k, CASE WHEN abs(s_acctbal) <= abs(s_acctbal - 5000) THEN 0 ELSE 1 END AS cluster FROM supplier")
def assign_suppliers(t):
    return cluster.assign(t("supplier"), ["s_acctbal"], [[0.0], [5000.0]]).select(F.col("s_suppkey").alias("k"), F.col("cluster").cast("int").alias("cluster"))


# ---- sparse and text --------------------------------------------------------------------------------


@query(f"WITH t AS {_RATE} SELECT CAST(u AS BIGINT) AS i, round(sum(r * (i % 7)), 6) AS value FROM t GROUP BY 1")
def sparse_times_dense_ratings(t):
    x = triples(t)
    m = x.select(F.col("key").alias("i")).distinct().select("i", F.lit(0).alias("j"), (F.col("i") % 7).cast("double").alias("value"))
    return sparse.multiply_dense(x, m).select(F.col("i").cast("bigint").alias("i"), F.round("value", 6).alias("value"))


@query(f"WITH t AS {_RATE}, m AS (SELECT max(u) + 1 AS n FROM t) SELECT CAST(u AS BIGINT) AS u, CAST(i AS BIGINT) AS i, u >= n * 1 // 4 AND u < n * 2 // 4 AS test FROM t, m")
def sparse_fold_ratings(t):
    x = triples(t)
    n = x.agg(F.max("row")).first()[0] + 1
    a, b = sparse.split_fold(x, n, 1, 4)
    pick = lambda d, v: d.select(F.col("row").cast("bigint").alias("u"), F.col("key").cast("bigint").alias("i"), F.lit(v).alias("test"))
    return pick(a, False).union(pick(b, True))


@query(f"WITH t AS {_RATE} SELECT round(sum(r * u), 0) AS rows, round(sum(r), 6) AS total FROM t")
def sparse_shuffle_ratings(t):
    x = triples(t)
    labels = x.select("row").distinct().withColumn("label", F.col("row"))
    y, lab = sparse.shuffled(x, labels, 3)
    return y.join(lab, "row").agg(F.round(F.sum(F.col("value") * F.col("label")), 0).alias("rows"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH t AS {_RATE} SELECT CAST(u AS BIGINT) AS u, round(coalesce(max(CASE WHEN i = 1 THEN r END), 0), 6) AS a, round(coalesce(max(CASE WHEN i = 2 THEN r END), 0), 6) AS b FROM t GROUP BY 1")
def sparse_to_dense_ratings(t):
    y = sparse.to_dense(triples(t), [1, 2])
    return y.select(F.col("row").cast("bigint").alias("u"), F.round("1", 6).alias("a"), F.round("2", 6).alias("b"))


# ---- graphs -----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE e AS {_TRADE}, p(a, n, c, h) AS (SELECT DISTINCT s, s, 0.0::DOUBLE, 0 FROM e UNION SELECT p.a, e.d, min(p.c + e.c), p.h + 1 FROM p JOIN e ON e.s = p.n WHERE p.h < 6 GROUP BY p.a, e.d, p.h) SELECT CAST(a AS INT) AS src, CAST(n AS INT) AS dst, round(min(c), 6) AS cost FROM p GROUP BY 1, 2")
def all_pairs_costs_trade(t):
    d, _ = graph.all_pairs(trade(t), 25)
    return local(t, [(i, j, round(float(d[i, j]), 6)) for i in range(25) for j in range(25) if np.isfinite(d[i, j])], "src int, dst int, cost double")


@query("SELECT 5.0::DOUBLE AS flow, 2 AS side")
def min_cut_small(t):
    """Node 0 to 5 over two narrow places: 1-2 of 3 and 1-3 of 2."""
    edges = [(0, 1, 9.0), (1, 2, 3.0), (1, 3, 2.0), (2, 4, 4.0), (3, 4, 4.0), (4, 5, 9.0)]
    value, side = graph.min_cut(6, edges, [0], [5])
    return local(t, [(float(value), len(side))], "flow double, side int")


@query("SELECT 3 AS length, count(*) AS n FROM (VALUES (0)) UNION ALL SELECT 4, 1")
def atomic_cycles_small(t):
    got = graph.atomic_cycles([(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 2)])
    return local(t, [(k, sum(len(c) == k for c in got)) for k in (3, 4)], "length int, n bigint")


# ---- sequences and signals --------------------------------------------------------------------------


def _series(t):
    x = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return x.select("user_id", F.col("s.value").alias("x"))


@query("SELECT user_id, round(sum(value * value), 1) AS energy FROM events GROUP BY 1")
def fft_energy_events(t):
    """Parseval: the energy of a series from its half spectrum."""
    x = _series(t).select("user_id", F.size("x").alias("n"), sequence.fft_magnitude(F.col("x")).alias("f"))
    twice = F.aggregate("f", F.lit(0.0), lambda s, v: s + 2 * v * v)
    edge = F.col("f")[0] ** 2 + F.when(F.col("n") % 2 == 0, F.element_at("f", -1) ** 2).otherwise(0.0)
    return x.select("user_id", F.round((twice - edge) / F.col("n"), 1).alias("energy"))


@query("SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY 1")
def fft_round_trip_events(t):
    x = _series(t).select("user_id", sequence.fft_roundtrip(F.col("x")).alias("y"))
    return x.select("user_id", F.round(F.aggregate("y", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


@query("SELECT user_id, round(sum(value) * 1.5, 6) AS loud, round(sum(value) * 0.75, 6) AS mixed, CAST(16 AS INT) AS still FROM events GROUP BY 1")
def amplify_mix_events(t):
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, v: s + v), 6)
    x = F.col("x")
    return _series(t).select("user_id", total(sequence.amplify(x, 1.5)).alias("loud"), total(sequence.mix(x, x, 0.5, 0.25)).alias("mixed"), F.size(sequence.silence(0.002, 8000)).alias("still"))


def _hmm():
    return sequence.HMM([0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [[0.8, 0.2], [0.3, 0.7]])


@query("WITH RECURSIVE e AS (SELECT user_id, CASE WHEN value > 100 THEN 1 ELSE 0 END AS o, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), f(u, k, a, b, l) AS (SELECT user_id, 1, 0.6 * (CASE WHEN o = 0 THEN 0.8 ELSE 0.2 END) / (0.6 * (CASE WHEN o = 0 THEN 0.8 ELSE 0.2 END) + 0.4 * (CASE WHEN o = 0 THEN 0.3 ELSE 0.7 END)), 0.4 * (CASE WHEN o = 0 THEN 0.3 ELSE 0.7 END) / (0.6 * (CASE WHEN o = 0 THEN 0.8 ELSE 0.2 END) + 0.4 * (CASE WHEN o = 0 THEN 0.3 ELSE 0.7 END)), ln(0.6::DOUBLE * (CASE WHEN o = 0 THEN 0.8 ELSE 0.2 END) + 0.4 * (CASE WHEN o = 0 THEN 0.3 ELSE 0.7 END)) FROM e WHERE k = 1 UNION ALL SELECT u, n, x / (x + y), y / (x + y), l + ln(x + y) FROM (SELECT f.u, e.k AS n, (f.a * 0.7::DOUBLE + f.b * 0.4) * (CASE WHEN o = 0 THEN 0.8 ELSE 0.2 END) AS x, (f.a * 0.3::DOUBLE + f.b * 0.6) * (CASE WHEN o = 0 THEN 0.3 ELSE 0.7 END) AS y, f.l FROM f JOIN e ON e.user_id = f.u AND e.k = f.k + 1)) SELECT u AS user_id, round(arg_max(l, k), 4) AS loglik FROM f GROUP BY 1")
def hmm_likelihood_events(t):
    x = t("events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", F.when(F.col("value") > 100, 1).otherwise(0).alias("o")))).alias("s")).select("user_id", F.col("s.o").alias("o"))

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        m = _hmm()
        return s.map(lambda o: float(m.log_likelihood(list(o))))

    return x.select("user_id", F.round(run("o"), 4).alias("loglik"))


# ---- generated data and optimisers ------------------------------------------------------------------


@query("SELECT i AS id, (i % 5) / 4.0::DOUBLE AS x, (i // 5 % 5) / 4.0::DOUBLE AS y, (i // 25) / 4.0::DOUBLE AS z FROM range(125) t(i)")
def cube_points(t):
    return generate.cube(t("region").sparkSession, 5)


@query("SELECT 'swiss_roll' AS name, 1000 AS n, true AS ok UNION ALL SELECT 's_curve', 1000, true UNION ALL SELECT 'spirals', 1000, true UNION ALL SELECT 'fish_bowl', 1000, true")
def manifold_shapes(t):
    """Points lie on their surfaces."""
    spark = t("region").sparkSession
    roll = generate.swiss_roll(spark, 1000, 2).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x") ** 2 + F.col("z") ** 2 < 1e4).alias("ok"))
    curve = generate.s_curve(spark, 1000, 2).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs("x") <= 1.000001).alias("ok"))
    spiral = generate.entwined_spirals(spark, 1000, 2).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("x").isNotNull()).alias("ok"))
    bowl = generate.fish_bowl(spark, 1000, 2).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.abs(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2 - 1) < 1e-6).alias("ok"))
    rows = [(name, *d.first()) for name, d in (("swiss_roll", roll), ("s_curve", curve), ("spirals", spiral), ("fish_bowl", bowl))]
    return local(t, rows, "name string, n int, ok boolean")


@query("SELECT 'hill' AS name, 3.0::DOUBLE AS x, -1.0::DOUBLE AS y UNION ALL SELECT 'momentum', 3, -1 UNION ALL SELECT 'gradient', 3, -1 UNION ALL SELECT 'direction', 3, -1 UNION ALL SELECT 'grid', 3, -1 UNION ALL SELECT 'swarm', 3, -1")
def optimisers_meet(t):
    loss = lambda p: (p[0] - 3) ** 2 + 2 * (p[1] + 1) ** 2
    d, start = distributions, np.zeros(2)
    got = {"hill": d.hill_climb(loss, start)[0], "momentum": d.momentum_search(loss, start)[0], "gradient": d.empirical_gradient(loss, start)[0], "direction": d.random_direction(loss, start, 3000)[0], "grid": d.grid_search(loss, [[1.0, 2.0, 3.0], [-2.0, -1.0, 0.0]])[0], "swarm": d.particle_swarm(loss, 2)[0]}
    return local(t, [(k, round(float(v[0]), 1) + 0.0, round(float(v[1]), 1) + 0.0) for k, v in got.items()], "name string, x double, y double")


@query("SELECT 5000 AS steps, 0 AS jumps, 25 AS cells, 12 AS first_cell, 0 AS other_rows FROM (SELECT count(*) AS n FROM nation)")
def grid_walk_nations(t):
    """5,000 steps over a grid of 5 x 5 nations: each goes one cell on, as its action says, and sees the nation there."""
    w = generate.grid_walk(t("region").sparkSession, 5000, 5, 5, seed=3, block=700)
    seen = generate.grid_observations(w, t("nation"), ["n_nationkey"], 5)
    dx, dy = (F.element_at(F.array(*map(F.lit, v)), F.col("action") + 1) for v in ((-1, 1, 0, 0), (0, 0, -1, 1)))
    after = w.select((F.col("id") - 1).alias("id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    jumps = w.join(after, "id").agg(F.count_if((F.col("nx") != F.col("x") + dx) | (F.col("ny") != F.col("y") + dy)).alias("jumps"))
    cell = F.col("y") * 5 + F.col("x")
    r = seen.agg(F.count(F.lit(1)), F.count_distinct(cell), F.min(F.when(F.col("id") == 0, cell)), F.count_if(cell != F.col("n_nationkey"))).first()
    return local(t, [(r[0], jumps.first()["jumps"], r[1], r[2], r[3])], "steps int, jumps int, cells int, first_cell int, other_rows int")


# ---- evaluation -------------------------------------------------------------------------------------


@query(f"WITH l AS {_LAB}, r AS (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS total, sum(CAST(label = '1' AS INT)) OVER (ORDER BY n_chars DESC, doc_id) AS found FROM l) SELECT CAST(found - 1 AS INT) AS hit, round(CASE WHEN total = 1 THEN 1 ELSE (found - 1) / (total - 1) END, 6) AS precision FROM r WHERE label = '1'")
def hit_precision_documents(t):
    x = labelled(t).select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("label") == "1").cast("int").alias("hit"))
    return evaluate.hit_precision(x, "doc_id", "score", "hit").select(F.col("hit").cast("int").alias("hit"), F.round("precision", 6).alias("precision"))
