"""The registered queries of the data-preparation operators, each over its whole tables, and their DuckDB twins.

The tables hold no nulls; where a query needs some, a key's remainder makes them, alike in both engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import sketches
from sievelake.functions.stats import number
from sievelake.operators import base, crossval, dedup, distance, evaluate, impute, inject, outliers, prior, profile, reduce, reward, scale, select, splines, validate
from sievelake.plans import mixture, search
from sievelake.plans.shared import forget, fresh_dir, written
from sievelake.sources import loaders

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def r(x: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


# ---- inputs with nulls, and their SQL

CUSTOMER = "(SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer)"
ORDERS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)"


def customer(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")


def orders(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"))


def lineitem(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount", "l_returnflag")


# ---- imputation

for _name, _kind, _agg in (("mean", impute.MeanImputer, "avg(c_acctbal)"), ("median", impute.MedianImputer, "median(c_acctbal)"), ("zero", impute.ZeroImputer, "max(0.0)")):

    @query(f"impute_{_name}", f"SELECT c_custkey, round(coalesce(c_acctbal, (SELECT {_agg} FROM {CUSTOMER})), 6) AS c_acctbal FROM {CUSTOMER}")
    def _(spark, sf, kind=_kind):
        return kind(columns=["c_acctbal"]).fit_transform(customer(spark, sf)).select("c_custkey", r("c_acctbal").alias("c_acctbal"))


@query("impute_mode", f"SELECT o_orderkey, coalesce(o_orderpriority, (SELECT o_orderpriority FROM {ORDERS} WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM {ORDERS}")
def impute_mode(spark, sf):
    return impute.MFImputer(columns=["o_orderpriority"]).fit_transform(orders(spark, sf)).select("o_orderkey", "o_orderpriority")


@query("impute_random")
def impute_random(spark, sf):
    return impute.RandomImputer(columns=["c_acctbal"], key="c_custkey").fit_transform(customer(spark, sf)).select("c_custkey", "c_acctbal")


@query(
    "outlier_lof_multivariate",
    """WITH n AS (SELECT * FROM (SELECT a.s_suppkey AS q, b.s_suppkey AS d, sqrt(power(a.s_acctbal - b.s_acctbal, 2) + power(a.s_nationkey - b.s_nationkey, 2)) AS distance,
           row_number() OVER (PARTITION BY a.s_suppkey ORDER BY sqrt(power(a.s_acctbal - b.s_acctbal, 2) + power(a.s_nationkey - b.s_nationkey, 2)), b.s_suppkey) AS r FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey) WHERE r <= 4),
       k AS (SELECT q, max(distance) AS far FROM n GROUP BY q), l AS (SELECT n.q, 1 / (avg(greatest(distance, far)) + 1e-10) AS density FROM n JOIN k ON k.q = n.d GROUP BY n.q),
       f AS (SELECT n.q, avg(t.density) / any_value(l.density) AS factor FROM n JOIN l ON l.q = n.q JOIN l t ON t.q = n.d GROUP BY n.q)
       SELECT q AS s_suppkey, round(factor, 6) AS factor FROM f WHERE factor <= (SELECT quantile_cont(factor, 0.9) FROM f)""",
)
def outlier_lof_multivariate(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    lof = outliers.MultivariateLOFCleaner(columns=["s_acctbal", "s_nationkey"], key="s_suppkey")
    kept = lof.fit_transform(s).select("s_suppkey")
    return kept.join(lof.factors(s, ["s_acctbal", "s_nationkey"]).withColumnRenamed("q", "s_suppkey"), "s_suppkey").select("s_suppkey", r("factor").alias("factor"))


SUPPLIER = "(SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_acctbal END AS a, CAST(s_nationkey AS DOUBLE) AS b FROM supplier)"


@query(
    "impute_knn",
    f"""WITH s AS {SUPPLIER}, d AS (SELECT q.s_suppkey AS k, n.a AS v, row_number() OVER (PARTITION BY q.s_suppkey ORDER BY sqrt(2.0 * power(q.b - n.b, 2)), n.s_suppkey) AS i
        FROM s q JOIN s n ON q.a IS NULL AND n.a IS NOT NULL)
        SELECT s.s_suppkey, round(coalesce(s.a, m.v), 6) AS a FROM s LEFT JOIN (SELECT k, avg(v) AS v FROM d WHERE i <= 5 GROUP BY k) m ON s.s_suppkey = m.k""",
)
def impute_knn(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal")).alias("a"), F.col("s_nationkey").cast("double").alias("b"))
    return impute.KNNImputer(columns=["a", "b"], key="s_suppkey").fit_transform(s).select("s_suppkey", r("a").alias("a"))


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_size").cast("double")).alias("p_size"), (F.col("p_partkey") % 100).cast("double").alias("p_group"))


@query("impute_em")
def impute_em(spark, sf):
    return impute.EMImputer(columns=["p_retailprice", "p_size", "p_group"]).fit_transform(_part(spark, sf))


@query("impute_mice")
def impute_mice(spark, sf):
    return impute.MICEImputer(columns=["p_retailprice", "p_size", "p_group"]).fit_transform(_part(spark, sf))


@query("impute_forward_fill", "SELECT c_custkey, last_value(c_acctbal IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c_acctbal FROM " + CUSTOMER)
def impute_forward_fill(spark, sf):
    return impute.ForwardFill(columns=["c_acctbal"], partition_by=["c_nationkey"], order_by=["c_custkey"]).transform(customer(spark, sf)).select("c_custkey", "c_acctbal")


@query("dropna_rows", f"SELECT * FROM {CUSTOMER} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL")
def dropna_rows(spark, sf):
    return impute.DropMissing().transform(customer(spark, sf))


@query("impute_parameterized", f"SELECT o_orderkey, round(coalesce(o_totalprice, (SELECT median(o_totalprice) FROM {ORDERS})), 4) AS o_totalprice FROM {ORDERS}")
def impute_parameterized(spark, sf):
    return impute.ParameterizedImputer(columns=["o_totalprice"]).set_params(strategy="median").fit_transform(orders(spark, sf)).select("o_orderkey", r("o_totalprice", 4).alias("o_totalprice"))


# ---- outliers

_IQR = "(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events))"
_Z = "(SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM events)"
_MAD = "(SELECT m - 1.6 * 1.4296 * d AS lo, m + 1.6 * 1.4296 * d AS hi FROM (SELECT m, (SELECT median(abs(value - m)) FROM events) AS d FROM (SELECT median(value) AS m FROM events)))"
_HOW = {"mask": "SELECT event_id, round(CASE WHEN value BETWEEN lo AND hi THEN value END, 6) AS value FROM events, {b}", "drop": "SELECT event_id, round(value, 6) AS value FROM events, {b} WHERE value BETWEEN lo AND hi", "clip": "SELECT event_id, round(CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END, 6) AS value FROM events, {b}"}
for _label, _kind, _bounds in (("iqr", outliers.IQROutlierCleaner, _IQR), ("zscore", outliers.ZScoreOutlierCleaner, _Z), ("robust_z", outliers.RobustZOutlierCleaner, _MAD)):
    for _how in _HOW if _label != "robust_z" else ("drop",):

        @query(f"outlier_{_label}_{_how}", _HOW[_how].format(b=_bounds))
        def _(spark, sf, kind=_kind, how=_how):
            return kind(columns=["value"], method=how).fit_transform(table(spark, sf, "events")).select("event_id", r("value").alias("value"))


@query(
    "outlier_fraction",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem, (SELECT quantile_cont(l_quantity, 0.25) AS a1, quantile_cont(l_quantity, 0.75) AS a3, quantile_cont(l_extendedprice, 0.25) AS b1, quantile_cont(l_extendedprice, 0.75) AS b3 FROM lineitem)"
    " WHERE NOT (l_quantity NOT BETWEEN a1 - 1.5 * (a3 - a1) AND a3 + 1.5 * (a3 - a1)) AND NOT (l_extendedprice NOT BETWEEN b1 - 1.5 * (b3 - b1) AND b3 + 1.5 * (b3 - b1))",
)
def outlier_fraction(spark, sf):
    return outliers.FractionOutlierCleaner(columns=["l_quantity", "l_extendedprice"], threshold=-1).fit_transform(table(spark, sf, "lineitem")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("outlier_lof")
def outlier_lof(spark, sf):
    return outliers.LocalOutlierFactorCleaner(columns=["p_retailprice"], key="p_partkey", method="drop").fit_transform(table(spark, sf, "part")).select("p_partkey", "p_retailprice")


@query("outlier_isolation_forest")
def outlier_isolation_forest(spark, sf):
    return outliers.IsolationForestCleaner(columns=["value"]).fit_transform(table(spark, sf, "events")).select("event_id", "value")


@query("outlier_parameterized", _HOW["drop"].format(b=_IQR.replace("1.5", "2.0")))
def outlier_parameterized(spark, sf):
    return outliers.ParameterizedOutlierRemover(columns=["value"], threshold=2.0).fit_transform(table(spark, sf, "events")).select("event_id", r("value").alias("value"))


# ---- duplicates

for _keep, _sql in ((("first"), "row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"), ("last", "row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1"), (False, "count(*) OVER (PARTITION BY text) = 1")):

    @query(f"dedup_exact_{str(_keep).lower().replace('false', 'none')}", f"SELECT doc_id FROM documents QUALIFY {_sql}")
    def _(spark, sf, keep=_keep):
        return dedup.ExactDeduplicator(columns=["text"], keep=keep, key="doc_id").transform(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


_FP = "array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(p_name || '|' || p_brand), '[^0-9a-z]+', ' ', 'g')), ' '))), ' ')"


@query("dedup_fingerprint", f"SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY {_FP.replace(chr(39) + '|' + chr(39), chr(39) + ' ' + chr(39))} ORDER BY p_partkey) = 1")
def dedup_fingerprint(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("text"))
    return dedup.FingerprintDeduplicator(columns=["text"], key="p_partkey", ascii=True).transform(p).select("p_partkey")


@query("dedup_fingerprint_unicode")
def dedup_fingerprint_unicode(spark, sf):
    return dedup.FingerprintDeduplicator(columns=["text"], key="doc_id").transform(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


@query("dedup_rounded", "SELECT s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY round(s_acctbal / 1000, 0), s_nationkey ORDER BY s_suppkey) = 1")
def dedup_rounded(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("k"), "s_nationkey")
    return dedup.RoundedDeduplicator(columns=["k", "s_nationkey"], key="s_suppkey", decimals=0).transform(s).select("s_suppkey")


_NAMES = "(SELECT min(p_partkey) AS k, p_name AS v FROM part GROUP BY p_name)"


@query("dedup_jaro_winkler_pairs", f"SELECT least(x.k, y.k) AS a, greatest(x.k, y.k) AS b, round(jaro_winkler_similarity(x.v, y.v), 6) AS similarity FROM {_NAMES} x JOIN {_NAMES} y ON x.k < y.k WHERE jaro_winkler_similarity(x.v, y.v) >= 0.85")
def dedup_jaro_winkler_pairs(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return dedup.ApproximateDeduplicator(key="k").links(names.select("k", "p_name"), ["p_name"]).select("a", "b", r("similarity").alias("similarity"))


@query("dedup_levenshtein_pairs", "SELECT x.n_nationkey AS a, y.n_nationkey AS b, round(1 - levenshtein(x.n_name, y.n_name) / CAST(greatest(length(x.n_name), length(y.n_name)) AS DOUBLE), 6) AS similarity FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey WHERE 1 - levenshtein(x.n_name, y.n_name) / CAST(greatest(length(x.n_name), length(y.n_name)) AS DOUBLE) >= 0.3")
def dedup_levenshtein_pairs(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return dedup.ApproximateDeduplicator(key="n_nationkey", comparison_type="levenshtein", threshold=0.3).links(n, ["n_name"]).select("a", "b", r("similarity").alias("similarity"))


@query("dedup_approximate_blocked")
def dedup_approximate_blocked(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return dedup.ApproximateDeduplicator(columns=["p_name"], key="p_partkey", blocking_col="p_brand").transform(p).select("p_partkey")


@query("dedup_sorted_neighbourhood")
def dedup_sorted_neighbourhood(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return dedup.ApproximateDeduplicator(columns=["p_name"], key="p_partkey", blocking_col="p_brand", indexing_method="sortedneighbourhood").transform(p).select("p_partkey")


@query("dedup_token_sort")
def dedup_token_sort(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey"))
    return dedup.TokenSortDeduplicator(key="p_partkey", columns=["p_name"]).transform(names)


@query("dedup_row_metric")
def dedup_row_metric(spark, sf):
    return dedup.RowStringDeduplicator(key="n_nationkey", columns=["n_name"], threshold=0.3, metric="DL").transform(table(spark, sf, "nation")).select("n_nationkey", "n_name")


_SETS = "(SELECT item_id AS k, list_distinct(list_filter(string_split(lower(regexp_replace(trim(text), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')) AS t FROM benchmark)"


@query("dedup_jaccard_pairs", f"SELECT * FROM (SELECT x.k AS a, y.k AS b, round(len(list_intersect(x.t, y.t)) / CAST(len(list_distinct(list_concat(x.t, y.t))) AS DOUBLE), 6) AS jaccard FROM {_SETS} x JOIN {_SETS} y ON x.k < y.k) WHERE jaccard >= 0.1")
def dedup_jaccard_pairs(spark, sf):
    b = table(spark, sf, "benchmark")
    return dedup.jaccard_links(dedup.token_sets(b, "item_id", F.col("text")), 0.1).select("a", "b", r("jaccard").alias("jaccard"))


@query("dedup_jaccard")
def dedup_jaccard(spark, sf):
    return dedup.JaccardSimilarityDeduplicator(columns=["text"], key="doc_id").transform(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id")


@query(
    "dedup_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, 1000000000 + l_suppkey AS b FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1),
       u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.n WHERE c.m < u.b)
       SELECT n AS node, min(m) AS component FROM c GROUP BY n""",
)
def dedup_components(spark, sf):
    from sievelake.plans.components import connected_components

    edges = table(spark, sf, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") + 1000000000).alias("b"))
    return connected_components(edges)


@query("duplicate_ratio", "SELECT round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 6) AS members, round((sum(n) - count(*)) / sum(n), 6) AS surplus FROM (SELECT count(*) AS n FROM part GROUP BY p_name, p_brand)")
def duplicate_ratio(spark, sf):
    return profile.duplicate_ratios(table(spark, sf, "part"), ["p_name", "p_brand"]).select(r("members").alias("members"), r("surplus").alias("surplus"))


# ---- scaling

_EV = "(SELECT avg(value) AS m, stddev_pop(value) AS s, min(value) AS lo, max(value) AS hi, median(value) AS q2, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, max(abs(value)) AS big FROM events)"
_SCALES = {
    "zscore": (scale.ZScoreScaler, {}, "(value - m) / CASE WHEN s = 0 THEN 1 ELSE s END"),
    "minmax": (scale.MinMaxScaler, {}, "(value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END"),
    "decimal": (scale.DecimalScaler, {}, "value / power(10, CASE WHEN big < 1 THEN 0 ELSE floor(log10(big)) + 1 END)"),
    "log10": (scale.Log10Scaler, {}, "log10(value + CASE WHEN lo <= 0 THEN abs(lo) + 1e-6 ELSE 0 END)"),
    "log1p": (scale.Log1pScaler, {}, "ln(1 + value + greatest(0, -lo))"),
    "robust": (scale.RobustScaler, {}, "(value - q2) / CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END"),
}
for _name, (_kind, _params, _sql) in _SCALES.items():

    @query(f"scale_{_name}", f"SELECT event_id, round({_sql}, 6) AS value FROM events, {_EV}")
    def _(spark, sf, kind=_kind, params=_params):
        return kind(columns=["value"], **params).fit_transform(table(spark, sf, "events")).select("event_id", r("value").alias("value"))


for _name, _kind, _params in (("quantile_uniform", scale.QuantileScaler, {"n_quantiles": 100}), ("quantile_normal", scale.QuantileScaler, {"n_quantiles": 100, "output_distribution": "normal"}), ("yeo_johnson", scale.PowerScaler, {}), ("box_cox", scale.PowerScaler, {"method": "box-cox"})):

    @query(f"scale_{_name}")
    def _(spark, sf, kind=_kind, params=_params):
        return kind(columns=["value"], **params).fit_transform(table(spark, sf, "events")).select("event_id", "value")


@query("label_encode", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM orders")
def label_encode(spark, sf):
    return scale.LabelEncoder(columns=["o_orderpriority"]).transform(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")).select("o_orderkey", "o_orderpriority")


@query("dummy_add", "SELECT n_nationkey + 1 AS n_nationkey, n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def dummy_add(spark, sf):
    return base.DummyAdd().transform(table(spark, sf, "nation"))


# ---- feature selection: (feature, score, kept)


def _selection(spark, selector) -> DataFrame:
    kept, scores = selector.stats["kept"], selector.stats["scores"]
    return spark.createDataFrame([(c, None if v is None else round(float(v), 6), c in kept) for c, v in scores.items()], "feature string, score double, kept boolean")


def _unpivot(exprs: dict[str, str], kept: str, source: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{c}' AS feature, {e} AS score FROM {source}" for c, e in exprs.items())
    return f"SELECT feature, round(score, 6) AS score, {kept} AS kept FROM ({parts})"


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("select_variance", _unpivot({c: f"var_pop({c})" for c in _FEATURES}, "score > 0.01", "lineitem"))
def select_variance(spark, sf):
    return _selection(spark, select.VarianceThresholdSelector(columns=_FEATURES, threshold=0.01).fit(table(spark, sf, "lineitem")))


@query("select_corr", _unpivot({"l_quantity": "max(0.0)", "l_extendedprice": "abs(corr(l_quantity, l_extendedprice))", "l_discount": "greatest(abs(corr(l_quantity, l_discount)), abs(corr(l_extendedprice, l_discount)))"}, "score <= 0.5", "lineitem"))
def select_corr(spark, sf):
    return _selection(spark, select.CollinearitySelector(columns=_FEATURES[:3], threshold=0.5).fit(table(spark, sf, "lineitem")))


@query("select_missing", _unpivot({c: f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)" for c in ("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")}, "score <= 0.1", CUSTOMER))
def select_missing(spark, sf):
    return _selection(spark, select.MissingRatioSelector(threshold=0.1).fit(customer(spark, sf)))


def _chi(c: str) -> str:
    return f"(SELECT sum(power(s - t * n / total, 2) / (t * n / total)) FROM (SELECT sum({c}) AS s, count(*) AS n, (SELECT sum({c}) FROM lineitem) AS t, (SELECT count(*) FROM lineitem) AS total FROM lineitem GROUP BY l_returnflag))"


@query("select_chi2", "SELECT feature, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC) <= 2 AS kept FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {_chi(c)} AS score" for c in _FEATURES) + ")")
def select_chi2(spark, sf):
    s = select.ChiSquareSelector(columns=_FEATURES, k=2, target="l_returnflag").fit(table(spark, sf, "lineitem"))
    return _selection(spark, s).withColumn("score", F.round("score", 4))


@query("select_fscore", "SELECT feature, round(rr * rr / (1 - rr * rr) * (n - 2), 2) AS score, row_number() OVER (ORDER BY rr * rr DESC) <= 2 AS kept FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS rr, count(*) AS n FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")) + ")")
def select_fscore(spark, sf):
    s = select.LinearCorrelationSelector(columns=["l_quantity", "l_discount", "l_tax"], k=2, target="l_extendedprice").fit(table(spark, sf, "lineitem"))
    return _selection(spark, s).withColumn("score", F.round("score", 2))


for _name, _kind, _params in (("mutual_info", select.MutualInformationSelector, {"k": 2, "key": ["l_orderkey", "l_linenumber"]}), ("random_forest", select.RandomForestSelector, {}), ("low_deviation", select.LowDeviationSelector, {}), ("lasso", select.LassoSelector, {})):

    @query(f"select_{_name}")
    def _(spark, sf, kind=_kind, params=_params):
        rows = table(spark, sf, "lineitem").withColumn("flag", (F.col("l_returnflag") == "R").cast("int"))
        return _selection(spark, kind(columns=_FEATURES, target="flag", **params).fit(rows))


@query("select_mutual_info_neighbours")
def select_mutual_info_neighbours(spark, sf):
    rows = table(spark, sf, "part").withColumn("band", F.col("p_partkey") % 3 + (F.col("p_retailprice") + F.col("p_size") > 950).cast("int"))
    return _selection(spark, select.MutualInformationSelector(columns=["p_size", "p_retailprice"], target="band", k=1, key="p_partkey").fit(rows))


@query("select_extra_trees")
def select_extra_trees(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("flag", (F.col("l_returnflag") == "R").cast("int"))
    return _selection(spark, select.ExtraTreesSelector(columns=_FEATURES, target="flag", max_depth=4).fit(rows))


@query("select_svc")
def select_svc(spark, sf):
    rows = table(spark, sf, "part").withColumn("band", F.when(F.col("p_retailprice") + F.col("p_size") > 950, "high").otherwise("low"))
    return _selection(spark, select.LinearSVCSelector(columns=["p_size", "p_retailprice"], target="band").fit(rows))


@query(
    "select_wr",
    """WITH l AS (SELECT l_returnflag AS y, unnest([struct_pack(feature := 'l_quantity', v := CAST(l_quantity AS DOUBLE)), struct_pack(feature := 'l_discount', v := CAST(l_discount AS DOUBLE))], recursive := true) FROM lineitem),
       s AS (SELECT feature, y, sum(v) AS o, count(*) AS n FROM l GROUP BY 1, 2), t AS (SELECT *, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM s)
       SELECT feature, round(sum(power(o - e, 2) / e), 6) AS score, true AS kept FROM t GROUP BY 1""",
)
def select_wr(spark, sf):
    return _selection(spark, select.ChiSquareSelector(columns=["l_quantity", "l_discount"], target="l_returnflag", k="all").fit(table(spark, sf, "lineitem")))


# ---- validation

_RULES = {"columns": {"c_custkey": {"dtype": "int"}, "c_acctbal": {"dtype": "float", "checks": {"in_range": [-500, 9000]}}, "c_mktsegment": {"nullable": True, "checks": {"isin": ["BUILDING", "AUTOMOBILE", "MACHINERY"]}}}}


@query("validate_schema", f"SELECT c_custkey FROM {CUSTOMER} WHERE c_acctbal BETWEEN -500 AND 9000 AND (c_mktsegment IS NULL OR c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY'))")
def validate_schema(spark, sf):
    return validate.SchemaValidator(schema_config=_RULES).transform(customer(spark, sf)).select("c_custkey")


@query("validate_regex", "SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(s_name, '^Supplier#0+[1-5]')")
def validate_regex(spark, sf):
    return validate.SchemaValidator(schema_config={"columns": {"s_name": {"checks": {"regex": "Supplier#0+[1-5]"}}}}).transform(table(spark, sf, "supplier")).select("s_suppkey", "s_name")


@query("validate_violations", f"SELECT 'c_custkey:dtype' AS \"check\", 0 AS failed UNION ALL SELECT 'c_custkey:nullable', 0 UNION ALL SELECT 'c_acctbal:dtype', 0 UNION ALL SELECT 'c_acctbal:nullable', count(*) FILTER (c_acctbal IS NULL) FROM {CUSTOMER} UNION ALL SELECT 'c_acctbal:in_range', count(*) FILTER (c_acctbal NOT BETWEEN -500 AND 9000) FROM {CUSTOMER} UNION ALL SELECT 'c_mktsegment:isin', count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')) FROM {CUSTOMER}")
def validate_violations(spark, sf):
    return validate.SchemaValidator(schema_config=_RULES).violations(customer(spark, sf))


@query("validate_constraints", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 300000 AND o_orderstatus IN ('F', 'O') AND length(o_orderpriority) >= 5")
def validate_constraints(spark, sf):
    rules = {"fields": {"o_totalprice": {"min": 1000, "max": 300000, "sign": "positive"}, "o_orderstatus": {"allowed_values": ["F", "O"]}, "o_orderpriority": {"min_length": 5}}}
    return validate.ConstraintChecker(constraints=rules).transform(table(spark, sf, "orders")).select("o_orderkey")


@query("validate_patterns", "SELECT o_orderkey, o_orderpriority FROM orders WHERE regexp_matches(o_orderpriority, '^1') OR regexp_matches(o_orderpriority, '^5-L')")
def validate_patterns(spark, sf):
    return validate.PatternChecker(patterns={"o_orderpriority": ["^1", "^5-L"]}).transform(table(spark, sf, "orders")).select("o_orderkey", "o_orderpriority")


@query("constraint_discovery", "SELECT 'o_totalprice' AS \"column\", round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high FROM orders UNION ALL SELECT 'o_orderkey', min(o_orderkey), max(o_orderkey) FROM orders UNION ALL SELECT 'o_orderpriority', min(length(o_orderpriority)), max(length(o_orderpriority)) FROM orders")
def constraint_discovery(spark, sf):
    found = validate.discover_constraints(table(spark, sf, "orders").select("o_totalprice", "o_orderkey", "o_orderpriority"))["fields"]
    return spark.createDataFrame([(c, round(float(f.get("min", f.get("min_length"))), 2), round(float(f.get("max", f.get("max_length"))), 2)) for c, f in found.items()], "column string, low double, high double")


@query("pattern_discovery")
def pattern_discovery(spark, sf):
    return spark.createDataFrame([(p,) for p in validate.discover_patterns(table(spark, sf, "orders"), "o_orderpriority")], "pattern string")


@query("mislabel_removal")
def mislabel_removal(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^!|#$%&*]", "")).alias("signs"), "quality")
    return validate.MislabelRemover(columns=["n_chars", "signs"], target="quality", key="doc_id").fit_transform(rows)


# ---- error injection

for _name, _f in (
    ("mcar", lambda c: inject.inject_mcar(c, 0.1, ["c_custkey"], ["c_acctbal"])),
    ("mar", lambda c: inject.inject_mar(c, 0.1, ["c_custkey"], columns=["c_acctbal", "c_nationkey"])),
    ("outliers", lambda c: inject.inject_outliers(c, 0.1, ["c_custkey"], columns=["c_acctbal"]).withColumn("c_acctbal", F.round("c_acctbal", 4))),
    ("duplicates", lambda c: inject.inject_duplicates(c, 0.1, ["c_custkey"])),
    ("label_noise", lambda c: inject.inject_label_noise(c, 0.1, ["c_custkey"], "c_mktsegment")),
    ("clusters", lambda c: inject.inject_cluster_missing(c, 0.3, ["c_custkey"], ["c_acctbal"])),
):

    @query(f"inject_{_name}")
    def _(spark, sf, f=_f):
        return f(table(spark, sf, "customer"))


# ---- distances: lineitem against its returned rows

_P, _Q = "(SELECT l_quantity, l_extendedprice, l_discount FROM lineitem)", "(SELECT l_quantity, l_extendedprice, l_discount FROM lineitem WHERE l_returnflag = 'R')"
_NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def sides(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.select(_NUM), rows.where("l_returnflag = 'R'").select(_NUM)


def _long(source: str, side: int) -> str:
    return " UNION ALL ".join(f"SELECT {side} AS side, '{c}' AS f, CAST({c} AS DOUBLE) AS v FROM {source}" for c in _NUM)


_LONG = f"l AS (SELECT * FROM ({_long(_P, 0)} UNION ALL {_long(_Q, 1)}) WHERE v IS NOT NULL)"
_HIST = f"""WITH {_LONG}, e AS (SELECT f, min(v) AS lo, max(v) AS hi FROM l GROUP BY f),
    b AS (SELECT side, l.f, least(CAST(floor((v - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin FROM l JOIN e USING (f)),
    n AS (SELECT f, count(*) FILTER (side = 0) AS np, count(*) FILTER (side = 1) AS nq FROM l GROUP BY f),
    g AS (SELECT f, unnest(range(0, 50)) AS bin FROM e),
    h AS (SELECT g.f, g.bin, count(*) FILTER (side = 0) / CAST(any_value(np) AS DOUBLE) AS p, count(*) FILTER (side = 1) / CAST(any_value(nq) AS DOUBLE) AS q FROM g JOIN n USING (f) LEFT JOIN b ON b.f = g.f AND b.bin = g.bin GROUP BY g.f, g.bin)"""
_KL = "sum(CASE WHEN p > 0 THEN p * ln(p / {m}) ELSE 0 END)"
_DIST = {
    "chi_squared": f"{_HIST} SELECT round(avg(v), 6) AS value FROM (SELECT 0.5 * sum(power(p - q, 2) / (p + q + 1e-10)) AS v FROM h GROUP BY f)",
    "hist_intersection": f"{_HIST} SELECT round(avg(v), 6) AS value FROM (SELECT greatest(0, least(1, 1 - sum(least(p, q)))) AS v FROM h GROUP BY f)",
    "hist_correlation": f"{_HIST} SELECT round(avg(v), 6) AS value FROM (SELECT 1 - corr(p, q) AS v FROM h GROUP BY f)",
    "jensen_shannon": f"{_HIST} SELECT round(avg(v), 6) AS value FROM (SELECT sqrt(({_KL.format(m='((p + q) / 2)')} + {_KL.format(m='((p + q) / 2)').replace('p > 0 THEN p * ln(p', 'q > 0 THEN q * ln(q')}) / 2) AS v FROM h GROUP BY f)",
    "kl_divergence": f"{_HIST}, k AS (SELECT f, p, CASE WHEN q = 0 THEN 1e-10 ELSE q END AS q FROM h), t AS (SELECT f, sum(q) AS t FROM k GROUP BY f) SELECT round(avg(v), 6) AS value FROM (SELECT {_KL.format(m='(q / t)')} AS v FROM k JOIN t USING (f) GROUP BY f)",
    "wasserstein": f"""WITH {_LONG}, c AS (SELECT f, v, count(*) FILTER (side = 0) AS cp, count(*) FILTER (side = 1) AS cq FROM l GROUP BY f, v),
        s AS (SELECT f, v, lead(v) OVER w AS nx, sum(cp) OVER w / CAST(sum(cp) OVER (PARTITION BY f) AS DOUBLE) AS fp, sum(cq) OVER w / CAST(sum(cq) OVER (PARTITION BY f) AS DOUBLE) AS fq FROM c WINDOW w AS (PARTITION BY f ORDER BY v))
        SELECT round(avg(v), 6) AS value FROM (SELECT sum(abs(fp - fq) * (nx - v)) AS v FROM s GROUP BY f)""",
    "row_count": f"SELECT round(abs((SELECT count(*) FROM {_Q}) - (SELECT count(*) FROM {_P})) / CAST((SELECT count(*) FROM {_P}) AS DOUBLE), 6) AS value",
    "missingness": "SELECT round(abs((SELECT avg(CASE WHEN l_quantity IS NULL THEN 1.0 ELSE 0.0 END) / 3 FROM {q}) - (SELECT avg(CASE WHEN l_quantity IS NULL THEN 1.0 ELSE 0.0 END) / 3 FROM {p})), 6) AS value".format(p="(SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity FROM lineitem)", q="(SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END AS l_quantity FROM lineitem WHERE l_returnflag = 'R')"),
    "correlation_matrix": "SELECT round(sqrt(2 * (" + " + ".join(f"power((SELECT corr({a}, {b}) FROM {_Q}) - (SELECT corr({a}, {b}) FROM {_P}), 2)" for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount"))) + ")), 6) AS value",
}
for _stat, _sql in (("skewness", "skewness"), ("kurtosis", "kurtosis"), ("variance", "var_samp")):
    for _how, _reduce in (("mean", "avg(v)"), ("max", "max(abs(v))"), ("median", "median(v)")):
        _DIST[f"{_stat}_{_how}"] = f"WITH {_LONG}, m AS (SELECT side, f, {_sql}(v) AS v FROM l GROUP BY side, f), a AS (SELECT side, {_reduce} AS v FROM m GROUP BY side) SELECT round(abs(max(CASE WHEN side = 1 THEN v END) - max(CASE WHEN side = 0 THEN v END)), {4 if _stat != 'variance' else 0}) AS value FROM a"
for _name, _sql in _DIST.items():

    @query(f"dist_{_name}", _sql)
    def _(spark, sf, name=_name):
        if name == "missingness":
            rows = lineitem(spark, sf)
            p, q = rows.select(_NUM), rows.where("l_returnflag = 'R'").select(_NUM)
        else:
            p, q = sides(spark, sf)
        digits = 6 if name.partition("_")[0] not in ("skewness", "kurtosis", "variance") else 0 if name.startswith("variance") else 4
        return distance.DISTANCES[name]().frame(p, q).select(r("value", digits).alias("value"))


@query("dist_categorical", "WITH p AS (SELECT o_orderpriority AS k, count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS p FROM orders GROUP BY 1), q AS (SELECT o_orderpriority AS k, count(*) / CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS DOUBLE) AS q FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT round(1 - sum(least(coalesce(p, 0), coalesce(q, 0))), 6) AS value FROM p FULL JOIN q USING (k)")
def dist_categorical(spark, sf):
    o = table(spark, sf, "orders")
    return distance.HistogramIntersection().frame(o.select("o_orderpriority"), o.where("o_orderstatus = 'F'").select("o_orderpriority")).select(r("value").alias("value"))


@query("dist_drift", f"WITH {_LONG}, c AS (SELECT f, v, count(*) FILTER (side = 0) AS cp, count(*) FILTER (side = 1) AS cq FROM l GROUP BY f, v), s AS (SELECT f, v, lead(v) OVER w AS nx, sum(cp) OVER w / CAST(sum(cp) OVER (PARTITION BY f) AS DOUBLE) AS fp, sum(cq) OVER w / CAST(sum(cq) OVER (PARTITION BY f) AS DOUBLE) AS fq FROM c WINDOW w AS (PARTITION BY f ORDER BY v)), d AS (SELECT f, sum(abs(fp - fq) * (nx - v)) AS w FROM s GROUP BY f), t AS (SELECT f, stddev_pop(v) AS sd FROM l WHERE side = 0 GROUP BY f) SELECT round(avg(least(w / sd, 5)), 6) AS value FROM d JOIN t USING (f)")
def dist_drift(spark, sf):
    return distance.normalised_drift(*sides(spark, sf)).select(r("value").alias("value"))


@query("dist_energy", f"WITH {_LONG}, c AS (SELECT f, v, count(*) FILTER (side = 0) AS cp, count(*) FILTER (side = 1) AS cq FROM l GROUP BY f, v), s AS (SELECT f, v, lead(v) OVER w AS nx, sum(cp) OVER w / CAST(sum(cp) OVER (PARTITION BY f) AS DOUBLE) AS fp, sum(cq) OVER w / CAST(sum(cq) OVER (PARTITION BY f) AS DOUBLE) AS fq FROM c WINDOW w AS (PARTITION BY f ORDER BY v)), e AS (SELECT f, sum(2 * power(fp - fq, 2) * (nx - v)) AS e FROM s GROUP BY f) SELECT round(avg(e), 6) AS value, round(avg(sqrt(e)), 6) AS root FROM e")
def dist_energy(spark, sf):
    return distance.energy_distance(*sides(spark, sf)).select(r("value").alias("value"), r("root").alias("root"))


def _named(spark, values: dict) -> DataFrame:
    return spark.createDataFrame([(k, None if v is None else float(f"{v:.5g}")) for k, v in values.items()], "measure string, value double")


@query("dist_mmd")
def dist_mmd(spark, sf):
    """Every row of both sides counts; the kernel is as wide as the middle distance of the reference's rows."""
    p, q = sides(spark, sf)
    rows = table(spark, sf, "lineitem")
    gamma = 1 / prior.median_distance(rows, _NUM, ["l_orderkey", "l_linenumber"]) ** 2
    value, error = prior.kernel_distance(prior.counted_rows(p, _NUM), prior.counted_rows(q, _NUM), _NUM, gamma, weight="_w")
    return _named(spark, {"gamma": gamma, "mmd": value, "error": error})


@query("dist_row_energy")
def dist_row_energy(spark, sf):
    held = [written(prior.counted_rows(side, _NUM), "rows") for side in sides(spark, sf)]  # read four times
    value, error = prior.row_energy(*held, _NUM, 16, weight="_w")
    forget(*held)
    return _named(spark, {"energy": value, "error": error})


@query("dist_c2st")
def dist_c2st(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return _named(spark, {"auc": prior.told_apart(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag <> 'R'"), _NUM, "key")})


@query("dist_prior_normal")
def dist_prior_normal(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return _named(spark, prior.prior_distances(rows, ["l_quantity", "l_extendedprice", "l_discount"], "key", 0, "normal"))


@query("dist_prior_networks")
def dist_prior_networks(spark, sf):
    return _named(spark, prior.prior_distances(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "c_custkey", 0, lines=16))


@query("prior_sample")
def prior_sample(spark, sf):
    """As many rows of the prior as the table has, by the row of the table that each stands beside."""
    n = table(spark, sf, "customer").count()
    drawn = prior.prior_sample(spark, n, ["x", "y"], 0)
    return drawn.select("id", r("x").alias("x"), r("y").alias("y"))


@query(
    "stats_auc",
    """WITH s AS (SELECT l_linestatus, l_returnflag = 'R' AS y, rank() OVER o + (count(*) OVER (PARTITION BY l_linestatus, l_extendedprice) - 1) / 2.0 AS k FROM lineitem WINDOW o AS (PARTITION BY l_linestatus ORDER BY l_extendedprice)),
       c AS (SELECT l_linestatus, count(*) FILTER (y) AS positives, count(*) FILTER (NOT y) AS negatives, sum(k) FILTER (y) AS r FROM s GROUP BY 1)
       SELECT l_linestatus, positives, negatives, round((r - positives * (positives + 1) / 2.0) / nullif(CAST(positives AS DOUBLE) * negatives, 0), 6) AS auc FROM c""",
)
def stats_auc(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_extendedprice").alias("score"))
    return prior.auc(rows, ["l_linestatus"]).withColumn("auc", r("auc"))


@query("dist_distortion")
def dist_distortion(spark, sf):
    return spark.createDataFrame([(round(float(distance.distortion(*sides(spark, sf))), 6),)], "value double")


# ---- profiles and observers


def _rates(c: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", round(1 - count({c}) / CAST(count(*) AS DOUBLE), 6) AS missing, count(DISTINCT {c}) AS \"distinct\", round(abs(skewness({c})), 4) AS abs_skew,"
        f" round(count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / CAST(count({c}) AS DOUBLE), 6) AS iqr_rate, round(count(*) FILTER (abs(({c} - m) / s) > 3) / CAST(count({c}) AS DOUBLE), 6) AS z_rate"
        f" FROM {CUSTOMER}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s FROM {CUSTOMER})"
    )


@query("profile_columns", f"{_rates('c_acctbal')} UNION ALL {_rates('c_nationkey')} UNION ALL SELECT 'c_mktsegment', round(1 - count(c_mktsegment) / CAST(count(*) AS DOUBLE), 6), count(DISTINCT c_mktsegment), 0.0, 0.0, 0.0 FROM {CUSTOMER}")
def profile_columns(spark, sf):
    return profile.profile_columns(customer(spark, sf).drop("c_custkey")).select("column", r("missing").alias("missing"), "distinct", r("abs_skew", 4).alias("abs_skew"), r("iqr_rate").alias("iqr_rate"), r("z_rate").alias("z_rate"))


@query("profile_dataset")
def profile_dataset(spark, sf):
    report = profile.DataProfiler().profile(customer(spark, sf), "c_mktsegment")
    names = ("n_rows", "n_columns", "missing", "duplicates", "iqr_rate", "z_rate", "skew", "cardinality", "imbalance")
    return spark.createDataFrame([(",".join(report.relevant_action_groups()), *(round(v, 4) for v in report.to_state_vector()))], "groups string, " + ", ".join(f"{n} double" for n in names))


@query("profile_summary", "SELECT 'o_orderkey' AS \"column\", count(*) FILTER (o_orderkey IS NULL) AS missing, count(DISTINCT o_orderkey) AS \"distinct\" FROM {o} UNION ALL SELECT 'o_orderpriority', count(*) FILTER (o_orderpriority IS NULL), count(DISTINCT o_orderpriority) + 1 FROM {o} UNION ALL SELECT 'o_totalprice', count(*) FILTER (o_totalprice IS NULL), count(DISTINCT o_totalprice) + 1 FROM {o}".format(o=ORDERS))
def profile_summary(spark, sf):
    return profile.summary(orders(spark, sf)).select("column", "missing", "distinct")


@query("observer_basic", f"SELECT count(*) AS \"rows\", 4 AS columns, count(*) FILTER (c_acctbal IS NULL) + count(*) FILTER (c_mktsegment IS NULL) AS nulls, 3 AS numeric, 1 AS others FROM {CUSTOMER}")
def observer_basic(spark, sf):
    return profile.DataStatsObserver().frame(customer(spark, sf))


@query("observer_advanced", "SELECT round((avg(power(l_quantity - a, 3)) / power(any_value(sa), 3) + avg(power(l_discount - b, 3)) / power(any_value(sb), 3)) / 2, 4) AS skew, round(abs(corr(l_quantity, l_discount)), 6) AS correlation, round((count(*) FILTER (l_quantity = 0) + count(*) FILTER (l_discount = 0)) / CAST(2 * count(*) AS DOUBLE), 6) AS zeros FROM lineitem, (SELECT avg(l_quantity) AS a, avg(l_discount) AS b, stddev_pop(l_quantity) AS sa, stddev_pop(l_discount) AS sb FROM lineitem)")
def observer_advanced(spark, sf):
    return profile.AdvancedStatsObserver().frame(table(spark, sf, "lineitem").select("l_quantity", "l_discount")).select(r("skew", 4).alias("skew"), r("correlation").alias("correlation"), r("zeros").alias("zeros"))


@query("observer_quality")
def observer_quality(spark, sf):
    whole = customer(spark, sf)
    found = profile.DataQualityObserver(whole, "c_mktsegment").frame(impute.DropMissing().transform(whole))
    return found.select(*(r(c, 5).alias(c) for c in found.columns))


# ---- rewards

@query("reward_completeness", f"SELECT round((1 - (count(*) FILTER (c_acctbal IS NULL) + count(*) FILTER (c_mktsegment IS NULL)) / CAST(4 * count(*) AS DOUBLE)), 6) AS completeness, count(*) AS n FROM {CUSTOMER}")
def reward_completeness(spark, sf):
    return reward.completeness(customer(spark, sf)).select(r("completeness").alias("completeness"), "n")


@query("reward_multi_objective")
def reward_multi_objective(spark, sf):
    rows = customer(spark, sf)
    own = reward.MultiObjectiveReward(evaluate.CARTEvaluator("c_mktsegment", ["c_custkey"], max_depth=3))
    own.reset(rows)
    return spark.createDataFrame([(a.name, float(own.score(a.fit_transform(rows)))) for a in (impute.MeanImputer(columns=["c_acctbal"]), impute.DropMissing())], "action string, reward double")


@query("reward_distortion")
def reward_distortion(spark, sf):
    rows = table(spark, sf, "events").select("value")
    own = reward.DataDistortionReward()
    own.reset(rows)
    return spark.createDataFrame([(a.name, float(own.score(a.fit_transform(rows)))) for a in (scale.ZScoreScaler(), outliers.IQROutlierCleaner(method="drop"))], "action string, reward double")


@query("reward_explained", "SELECT action, round(mean_delta, 6) AS mean_delta, n FROM (SELECT event_type AS action, avg(value) AS mean_delta, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
def reward_explained(spark, sf):
    return reward.action_ranking(table(spark, sf, "events"), "event_type", "value", 3).select(F.col("event_type").alias("action"), r("mean_delta").alias("mean_delta"), "n")


@query("reward_cumulative", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cumulative FROM events")
def reward_cumulative(spark, sf):
    history = table(spark, sf, "events").select("event_id", "user_id", F.col("event_id").alias("step"), F.col("value").alias("delta"))
    return reward.cumulative_rewards(history, ["user_id"]).select("event_id", r("cumulative", 4).alias("cumulative"))


# ---- evaluation

_SCORED = "(SELECT doc_id, quality AS label, (doc_id * 7919 % 1000) / 1000.0 AS score, CASE WHEN doc_id * 7919 % 1000 >= 500 THEN 1 ELSE 0 END AS prediction FROM labels)"


def scored(spark, sf):
    s = F.col("doc_id") * 7919 % 1000
    return table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"), (s / 1000.0).alias("score"), (s >= 500).cast("int").alias("prediction"))


@query("eval_confusion", f"SELECT label, prediction, count(*) AS n FROM {_SCORED} GROUP BY 1, 2")
def eval_confusion(spark, sf):
    return evaluate.confusion(scored(spark, sf))


@query("eval_f1_macro", f"WITH c AS (SELECT unnest([0, 1]) AS c), m AS (SELECT c, count(*) FILTER (label = c) AS actual, count(*) FILTER (prediction = c) AS predicted, count(*) FILTER (label = c AND prediction = c) AS hit FROM c, {_SCORED} GROUP BY c) SELECT round(sum(hit) / CAST(sum(actual) AS DOUBLE), 6) AS accuracy, round(avg(coalesce(hit / CAST(nullif(predicted, 0) AS DOUBLE), 0)), 6) AS precision, round(avg(coalesce(hit / CAST(nullif(actual, 0) AS DOUBLE), 0)), 6) AS recall, round(avg(2.0 * hit / (actual + predicted)), 6) AS f1 FROM m")
def eval_f1_macro(spark, sf):
    return evaluate.classification_metrics(scored(spark, sf)).select(*(r(c).alias(c) for c in ("accuracy", "precision", "recall", "f1")))


@query("eval_ece", f"WITH b AS (SELECT floor(score * 10) AS b, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS a, avg(score) AS m FROM {_SCORED} GROUP BY 1) SELECT round(sum(abs(a - m) * n) / sum(n), 6) AS ece FROM b")
def eval_ece(spark, sf):
    rows = scored(spark, sf).withColumn("correct", F.col("label") == F.col("prediction"))
    return evaluate.expected_calibration_error(rows, confidence="score").select(r("ece").alias("ece"))


@query("eval_threshold_f1", f"WITH c AS (SELECT round(score, 4) AS threshold, sum(label) AS tp, count(*) AS n FROM {_SCORED} GROUP BY 1), f AS (SELECT threshold, 2.0 * sum(tp) OVER w / (sum(n) OVER w + sum(tp) OVER ()) AS f1 FROM c WINDOW w AS (ORDER BY threshold DESC)) SELECT threshold, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1")
def eval_threshold_f1(spark, sf):
    return evaluate.best_f1_threshold(scored(spark, sf)).select("threshold", r("f1").alias("f1"))


@query("eval_ols", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def eval_ols(spark, sf):
    y, x = number("l_extendedprice"), number("l_quantity")
    return table(spark, sf, "lineitem").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


_PART_KEY = ["p_partkey"]


def _banded(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.when(F.col("p_retailprice") + F.col("p_size") > 950, "high").otherwise("low").alias("band"))


for _kind in ("nb", "lda", "mnb", "cart"):

    @query(f"eval_kfold_{_kind}")
    def _(spark, sf, kind=_kind):
        grid = [{"max_depth": d} for d in (3, 5)] if kind == "cart" else None
        model = crossval.KFoldClassifier("band", _PART_KEY, ["p_size", "p_retailprice"], kind, 3 if kind == "cart" else 10, grid)
        return model.results(_banded(spark, sf)).select(F.col("point").cast("int").alias("point"), F.col("fold").cast("int").alias("fold"), "n", "hits")


@query("eval_kfold_ols")
def eval_kfold_ols(spark, sf):
    found = crossval.KFoldRegression("p_retailprice", _PART_KEY, ["p_size"]).results(table(spark, sf, "part"))
    return spark.createDataFrame([(x["fold"], x["n"], round(x["mse"], 4)) for x in found], "fold int, n long, mse double")


@query("eval_kfold_lasso")
def eval_kfold_lasso(spark, sf):
    found = crossval.KFoldRegression("l_extendedprice", ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], 10, [0.01, 0.1, 1.0, 10.0, 100.0]).results(table(spark, sf, "lineitem"))
    return spark.createDataFrame([(x["alpha"], x["fold"], x["n"], round(x["mse"], 2)) for x in found], "alpha double, fold int, n long, mse double")


@query("eval_mars")
def eval_mars(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return splines.MARSEvaluator("l_extendedprice", ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"]).predictions(rows).select("l_orderkey", "l_linenumber", "label", r("prediction", 3).alias("prediction"))


@query("eval_lda_nulls")
def eval_lda_nulls(spark, sf):
    rows = _banded(spark, sf).withColumn("p_size", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")))
    return evaluate.LDAEvaluator("band", _PART_KEY, ["p_size", "p_retailprice"]).predictions(rows).withColumn("confidence", F.round("confidence", 6))


for _name, _kind, _params in (("tree", evaluate.CARTEvaluator, {}), ("lda", evaluate.LDAEvaluator, {}), ("gaussian_nb", evaluate.GaussianNBEvaluator, {}), ("multinomial_nb", evaluate.MultinomialNBEvaluator, {}), ("random_forest", evaluate.RandomForestEvaluator, {"n_estimators": 10}), ("logistic", evaluate.LogisticEvaluator, {})):

    @query(f"eval_{_name}")
    def _(spark, sf, kind=_kind, params=_params):
        rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", F.when(F.col("p_retailprice") + F.col("p_size") > 950, "high").otherwise("low").alias("band"))
        return kind("band", _PART_KEY, ["p_size", "p_retailprice"], **params).predictions(rows).withColumn("confidence", F.round("confidence", 6))


for _name, _kind, _params in (("linear_regression", evaluate.OLSEvaluator, {}), ("lasso", evaluate.LassoEvaluator, {}), ("boosted_regression", evaluate.GBREvaluator, {}), ("kernel_ridge", crossval.KernelRidgeEvaluator, {"cosines": 64, "gammas": [0.01, 0.1, 1.0]})):

    @query(f"eval_{_name}")
    def _(spark, sf, kind=_kind, params=_params):
        return kind("p_retailprice", _PART_KEY, ["p_size", "p_group"], **params).predictions(_part(spark, sf)).withColumn("prediction", F.round("prediction", 4))


for _name, _kind in (("kmeans", evaluate.KMeansEvaluator), ("agglomerative", evaluate.AgglomerativeEvaluator)):

    @query(f"eval_{_name}")
    def _(spark, sf, kind=_kind):
        score, k = kind(["p_size", "p_retailprice"], (2, 3)).evaluate(table(spark, sf, "part"))
        return spark.createDataFrame([(float(score), k)], "silhouette double, k int")


@query("eval_dbscan")
def eval_dbscan(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 50).alias("x"), (F.col("p_retailprice") / 2000).alias("y"))
    return evaluate.dbscan(rows, "p_partkey", ["x", "y"], eps=0.02)


# ---- statistics, windows, pivots

@query("stats_ci95", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, round(1.96 * stddev_samp(value) / sqrt(count(value)), 6) AS ci95 FROM events GROUP BY 1")
def stats_ci95(spark, sf):
    return evaluate.confidence_interval(table(spark, sf, "events"), ["event_type"], "value").select("event_type", "n", r("mean").alias("mean"), r("sd").alias("sd"), r("ci95").alias("ci95"))


@query("stats_spearman", "WITH k AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderstatus, o_custkey) - 1) / 2.0 AS b FROM orders) SELECT o_orderstatus, round(corr(a, b), 6) AS rho, count(*) AS n FROM k GROUP BY 1")
def stats_spearman(spark, sf):
    return evaluate.spearman(table(spark, sf, "orders"), ["o_orderstatus"], "o_totalprice", "o_custkey").select("o_orderstatus", r("rho").alias("rho"), "n")


@query("stats_partial_spearman")
def stats_partial_spearman(spark, sf):
    return evaluate.partial_spearman(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice", "l_discount").select("l_returnflag", r("rho").alias("rho"))


@query("stats_one_sample_t", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round((avg(value) - 50) / (stddev_samp(value) / sqrt(count(value))), 6) AS t FROM events GROUP BY 1")
def stats_one_sample_t(spark, sf):
    return evaluate.one_sample_t(table(spark, sf, "events"), ["event_type"], "value", 50.0).select("event_type", "n", r("mean").alias("mean"), r("t").alias("t"))


@query(
    "stats_wilcoxon",
    """WITH d AS (SELECT l_returnflag, l_quantity * 1000 - l_extendedprice AS d FROM lineitem WHERE l_quantity * 1000 <> l_extendedprice),
       c AS (SELECT l_returnflag, abs(d) AS a, count(*) AS c, count(*) FILTER (d > 0) AS p FROM d GROUP BY 1, 2),
       k AS (SELECT *, sum(c) OVER (PARTITION BY l_returnflag ORDER BY a) - (c - 1) / 2.0 AS r FROM c),
       s AS (SELECT l_returnflag, CAST(sum(c) AS BIGINT) AS n, least(sum(r * p), sum(r * (c - p))) AS w, sum(power(c, 3) - c) AS ties FROM k GROUP BY 1)
       SELECT l_returnflag, n, CAST(w AS DOUBLE) AS w, round((w - n * (n + 1.0) / 4) / sqrt(n * (n + 1.0) * (2 * n + 1.0) / 24 - ties / 48), 6) AS z FROM s""",
)
def stats_wilcoxon(spark, sf):
    return evaluate.wilcoxon(table(spark, sf, "lineitem").withColumn("a", F.col("l_quantity") * 1000), ["l_returnflag"], "a", "l_extendedprice").select("l_returnflag", "n", "w", r("z").alias("z"))


@query("grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def grouping_sets(spark, sf):
    return evaluate.grouped_totals(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice").select("o_orderstatus", "o_orderpriority", "n", r("total", 2).alias("total"), r("mean", 4).alias("mean"), F.col("level").cast("long").alias("level"))


@query("align_target", f"SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT c_custkey FROM {CUSTOMER} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL)")
def align_target(spark, sf):
    return evaluate.align_target(impute.DropMissing().transform(customer(spark, sf)), table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")


@query("stats_pareto", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size >= p.p_size AND o.p_retailprice >= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice > p.p_retailprice))")
def stats_pareto(spark, sf):
    return evaluate.pareto_front(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey")


@query("stats_power_law", "SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS exponent, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0")
def stats_power_law(spark, sf):
    return evaluate.power_law(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(r("exponent").alias("exponent"), r("r2").alias("r2"))


@query("moving_average", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS moving_average FROM events")
def moving_average(spark, sf):
    return evaluate.moving_average(table(spark, sf, "events"), ["user_id"], "event_id", "value").select("event_id", r("moving_average").alias("moving_average"))


@query("class_balance", "SELECT o_orderstatus, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM orders GROUP BY 1")
def class_balance(spark, sf):
    o = table(spark, sf, "orders")
    total = o.agg(F.count(F.lit(1)).alias("t"))  # one row
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).join(total).select("o_orderstatus", "n", r(F.col("n") / F.col("t")).alias("share"))


@query(
    "pivot_delta",
    "SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS f, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS o, round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) - avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS delta FROM orders GROUP BY 1",
)
def pivot_delta(spark, sf):
    found = evaluate.pivot_delta(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "F", "O")
    return found.select("o_orderpriority", r("F", 4).alias("f"), r("O", 4).alias("o"), r("delta", 4).alias("delta"))


def _cube(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey", "l_quantity")
    return sketches.merge_cube(written(sketches.sketch(rows, ["l_returnflag", "l_linestatus"], ["l_orderkey"], ["l_extendedprice"], ["l_quantity"]), "sketches"), ["l_returnflag", "l_linestatus"])


@query(
    "sketch_cube_buckets",
    f"""SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus) AS level, CAST(ceil(ln(l_extendedprice) / {math.log(sketches.GAMMA)!r}) AS BIGINT) + 524288 AS slot, count(*) AS v FROM lineitem
        GROUP BY GROUPING SETS ((l_returnflag, l_linestatus, slot), (l_returnflag, slot), (l_linestatus, slot), (slot))""",
)
def sketch_cube_buckets(spark, sf):
    """The buckets of the quantile sketch, merged up the cube from the finest groups alone."""
    return _cube(spark, sf).where("kind = 'quantile'").select("l_returnflag", "l_linestatus", F.col("level").cast("long").alias("level"), "slot", "v")


@query("sketch_cube")
def sketch_cube(spark, sf):
    cube, by = written(_cube(spark, sf), "cube"), ["level", "l_returnflag", "l_linestatus"]
    distinct = sketches.distinct_counts(cube, by).select(*by, r("distinct", 3).alias("orders"))
    middle = sketches.quantiles(cube, by, [0.25, 0.5, 0.75]).select(*by, "n", F.transform("quantiles", lambda v: F.round(v, 3)).alias("quartiles"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by]
    return distinct.alias("d").join(middle.alias("m"), same[0] & same[1] & same[2]).select(*(f"d.{c}" for c in by), "orders", "n", "quartiles")


# ---- reduction and balancing

@query("reduce_pca")
def reduce_pca(spark, sf):
    return reduce.PCAReducer(columns=["p_size", "p_retailprice"], k=2).fit_transform(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"))


@query("reduce_random_projection")
def reduce_random_projection(spark, sf):
    return reduce.RandomProjector(columns=["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).fit_transform(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *_FEATURES))


@query("balance_smote")
def balance_smote(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), "quality")
    return reduce.SMOTEBalancer(columns=["n_chars"], key="doc_id", target="quality").fit_transform(rows)


# ---- search

@query("search_permutations")
def search_permutations(spark, sf):
    """Every ordered choice of three operators, by its number, and its score on the table."""
    rows = customer(spark, sf)
    space = search.PermutationSpace([_groups()["imputation"][0], _groups()["outliers"][0], _groups()["scaling"][0]])
    return search.score_pipelines(rows, [space.unrank(i) for i in range(len(space))], {"completeness": _scorer(rows)}).select("pipeline", F.round("value", 6).alias("value"))


def _groups():
    return {"imputation": [impute.MeanImputer(columns=["c_acctbal"], name="mean"), impute.MedianImputer(columns=["c_acctbal"], name="median")], "outliers": [outliers.IQROutlierCleaner(columns=["c_acctbal"], method="drop", name="iqr")], "scaling": [scale.MinMaxScaler(columns=["c_acctbal"], name="minmax")]}


def _scorer(rows):
    own = reward.CompletenessRetentionReward()
    own.reset(rows)
    return own


@query("search_best_pipeline")
def search_best_pipeline(spark, sf):
    rows = customer(spark, sf)
    return search.score_pipelines(rows, list(search.valid_pipelines(_groups(), 2)), {"completeness": _scorer(rows)}).withColumn("value", F.round("value", 6))


@query("search_greedy")
def search_greedy(spark, sf):
    rows = customer(spark, sf)
    chosen, value = search.greedy_search(rows, _groups(), _scorer(rows), 1)
    return spark.createDataFrame([(g, a.name if a else None, round(float(value), 6)) for g, a in chosen.items()], "family string, action string, score double")


@query("search_genetic")
def search_genetic(spark, sf):
    rows = customer(spark, sf)
    return spark.createDataFrame([(float(v), " > ".join(p)) for v, p in search.genetic_search(rows, _groups(), _scorer(rows), population=6, generations=2)], "score double, pipeline string")


@query("search_qlearning")
def search_qlearning(spark, sf):
    rows = customer(spark, sf)
    _, _, found = search.QLearner(_groups(), episodes=200).search(rows, _scorer(rows))
    return spark.createDataFrame([(" > ".join(p), float(v)) for p, v in found], "pipeline string, score double")


@query("search_sequential_env")
def search_sequential_env(spark, sf):
    rows = customer(spark, sf)
    actions = [a for own in _groups().values() for a in own]
    env = search.SequentialCleaningEnv(rows, actions, _scorer(rows), profile.DataStatsObserver())
    env.reset()
    steps = [env.step(i) for i in (0, 2, 2)]
    return spark.createDataFrame([(i, round(float(s.reward), 6), s.terminated) for i, s in enumerate(steps)], "step int, reward double, terminated boolean")


@query("search_weights", "WITH g AS (SELECT i / 10.0 AS a, j / 10.0 AS b, (10 - i - j) / 10.0 AS c FROM (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j) WHERE i + j <= 10), s AS (SELECT l_returnflag, l_suppkey, avg(l_quantity) / 50 AS x, avg(l_discount) * 10 AS y, avg(l_tax) * 10 AS z FROM lineitem GROUP BY 1, 2) SELECT l_returnflag, round(a, 1) AS w0, round(b, 1) AS w1, round(c, 1) AS w2, round(max(a * x + b * y + c * z), 6) AS value FROM s, g GROUP BY 1, 2, 3, 4")
def search_weights(spark, sf):
    s = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey").agg((F.avg("l_quantity") / 50).alias("x"), (F.avg("l_discount") * 10).alias("y"), (F.avg("l_tax") * 10).alias("z"))
    return search.best_under_weights(s, ["l_returnflag"], "l_suppkey", ("x", "y", "z"), search.weight_grid()).select("l_returnflag", *(r(f"w{k}", 1).alias(f"w{k}") for k in range(3)), r("value").alias("value"))


_IMPACT = "WITH v AS (SELECT value AS p, {moved} AS q FROM events, {ev}), l AS (SELECT 0 AS side, p AS v FROM v UNION ALL SELECT 1, q FROM v WHERE q IS NOT NULL), c AS (SELECT v, count(*) FILTER (side = 0) AS cp, count(*) FILTER (side = 1) AS cq FROM l GROUP BY v), s AS (SELECT v, lead(v) OVER w AS nx, sum(cp) OVER w / CAST(sum(cp) OVER () AS DOUBLE) AS fp, sum(cq) OVER w / CAST(sum(cq) OVER () AS DOUBLE) AS fq FROM c WINDOW w AS (ORDER BY v)) SELECT '{a}' AS action, 'wasserstein' AS metric, round(sum(abs(fp - fq) * (nx - v)), 6) AS value FROM s"


@query("action_impact_matrix", " UNION ALL ".join(f"SELECT * FROM ({_IMPACT.format(a=a, moved=m, ev=_EV)})" for a, m in (("minmax", _SCALES["minmax"][2]), ("robust", _SCALES["robust"][2]), ("clip", "CASE WHEN value < q1 - 1.5 * (q3 - q1) THEN q1 - 1.5 * (q3 - q1) WHEN value > q3 + 1.5 * (q3 - q1) THEN q3 + 1.5 * (q3 - q1) ELSE value END"))))
def action_impact_matrix(spark, sf):
    rows = table(spark, sf, "events").select("value")
    actions = [scale.MinMaxScaler(name="minmax"), scale.RobustScaler(name="robust"), outliers.IQROutlierCleaner(method="clip", name="clip")]
    return search.impact_matrix(rows, rows, actions, [distance.Wasserstein()]).withColumn("value", F.round("value", 6))


# ---- sources and streams

@query("source_date_features", "SELECT o_orderkey, CAST(epoch(o_orderdate) - 1483228800 AS DOUBLE) AS \"o_orderdate_TIMESTAMP\", year(o_orderdate) AS \"o_orderdate_YEAR\", month(o_orderdate) AS \"o_orderdate_MONTH\", day(o_orderdate) AS \"o_orderdate_DAY\", isodow(o_orderdate) - 1 AS \"o_orderdate_DAYOFWEEK\" FROM orders")
def source_date_features(spark, sf):
    return loaders.date_features(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate").drop("o_orderdate_HOUR")


@query("source_list_columns", "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}] AS embedding_item{i + 1}" for i in range(64)) + " FROM embeddings")
def source_list_columns(spark, sf):
    return loaders.list_to_columns(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")


@query("source_split")
def source_split(spark, sf):
    return evaluate.stratified_split(table(spark, sf, "customer"), ["c_custkey"], "c_mktsegment").groupBy("c_mktsegment", "split").agg(F.count(F.lit(1)).alias("n"))


def _event_stream(spark, sf):
    """The events as a stream; a pattern, as a stream's plain path must be a folder and the table may be one file."""
    from sievelake.streaming import streams

    return streams.read_table_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)


@query("stream_quality", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def stream_quality(spark, sf):
    """Windowed quality of the table read as a stream, summed over the windows."""
    from sievelake.streaming import streams

    stream = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    by = streams.run_to_table(streams.windowed_quality(stream, "ts", "value", "1 hour", by=["event_type"]))
    return by.groupBy("event_type").agg(F.sum("n").alias("n"), r(F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))


# ---- the flagship: nulls in, mean fill, outliers out, z-scores; what stayed, and how far the column moved

@query(
    "prepare_and_score",
    """WITH raw AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_extendedprice END AS v FROM lineitem),
       filled AS (SELECT coalesce(v, (SELECT avg(v) FROM raw)) AS v FROM raw),
       b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM filled)),
       kept AS (SELECT v FROM filled, b WHERE v BETWEEN lo AND hi)
       SELECT (SELECT count(*) FROM raw) AS rows_in, count(*) AS rows_out, round(sqrt(count(*) / CAST((SELECT count(*) FROM raw) AS DOUBLE)), 6) AS reward, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS sd FROM kept""",
)
def prepare_and_score(spark, sf):
    raw = table(spark, sf, "lineitem").select(F.when(F.col("l_orderkey") % 7 != 0, F.col("l_extendedprice")).alias("v"))
    kept = base.Pipeline([impute.MeanImputer(), outliers.IQROutlierCleaner(method="drop")]).fit_transform(raw)
    scaler = scale.ZScoreScaler().fit(kept)
    out = scaler.transform(kept).agg(F.count(F.lit(1)).alias("rows_out"))
    n = raw.agg(F.count(F.lit(1)).alias("rows_in"))
    return n.join(out).select("rows_in", "rows_out", r(F.sqrt(F.col("rows_out") / F.col("rows_in"))).alias("reward"), F.lit(round(scaler.stats["mean_v"], 4)).alias("mean"), F.lit(round(scaler.stats["sd_v"], 4)).alias("sd"))


@query("stream_scaled", "SELECT event_id, round((value - (SELECT min(value) FROM events)) / (SELECT max(value) - min(value) FROM events), 6) AS value FROM events")
def stream_scaled(spark, sf):
    """An operator that was fitted on the table at rest, on the table as a stream."""
    from sievelake.streaming import streams

    rows = table(spark, sf, "events")
    stream = _event_stream(spark, sf)
    fitted = [scale.MinMaxScaler(columns=["value"]).fit(rows)]
    return streams.run_to_table(streams.apply_fitted(stream, fitted), "append").select("event_id", r("value").alias("value"))


# ---- twins of queries above that need more than a line


def _unit(*parts: str, seed: int = 42) -> str:
    """SQL of hash_unit."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)}, '{seed}')), 1, 12) AS BIGINT) / 281474976710656.0)"


def _ranked(columns: list[str], by: str, source: str) -> str:
    mean = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0"
    return f"SELECT {by}, " + ", ".join(f"{mean(c)} AS r{i}" for i, c in enumerate(columns)) + f" FROM {source}"


_KEY, _BAL = "CAST(c_custkey AS VARCHAR)", "'c_acctbal'"
_CELL = "CASE WHEN {hit} THEN NULL ELSE {c} END AS {c}"
SQL["inject_mcar"] = f"SELECT * REPLACE ({_CELL.format(hit=_unit(_KEY, _BAL) + ' < 0.1', c='c_acctbal')}) FROM customer"
SQL["inject_mar"] = f"SELECT * REPLACE ({_CELL.format(hit='c_acctbal > (SELECT quantile_cont(c_acctbal, 0.75) FROM customer) AND ' + _unit(_KEY, chr(39) + 'c_nationkey' + chr(39)) + ' < 0.4', c='c_nationkey')}) FROM customer"
SQL["inject_outliers"] = (
    "WITH m AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) SELECT c.* REPLACE (round(CASE WHEN " + _unit(_KEY, _BAL) + " < 0.1 THEN m + (CASE WHEN " + _unit(_KEY, _BAL, seed=43) + " < 0.5 THEN -1 ELSE 1 END) * 3 * s"
    " + sqrt(-2 * ln(1 - " + _unit(_KEY, _BAL, seed=44) + ")) * cos(" + _unit(_KEY, _BAL, seed=45) + " * 6.283185307179586) * s / 10 ELSE c_acctbal END, 4) AS c_acctbal) FROM customer c, m"
)
SQL["inject_duplicates"] = f"SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE {_unit(_KEY, chr(39) + 'row' + chr(39))} < 0.1"
SQL["inject_label_noise"] = (
    "WITH k AS (SELECT list(DISTINCT c_mktsegment ORDER BY c_mktsegment) AS k FROM customer) SELECT c.* REPLACE (CASE WHEN " + _unit(_KEY, "'label'") + " < 0.1"
    " THEN list_filter(k, lambda x: x <> c_mktsegment)[1 + CAST(floor(" + _unit(_KEY, "'class'", seed=43) + " * (len(k) - 1)) AS BIGINT)] ELSE c_mktsegment END AS c_mktsegment) FROM customer c, k"
)
SQL["impute_random"] = (
    f"WITH c AS {CUSTOMER}, o AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY {_unit(_KEY, _BAL)}, c_acctbal) - 1 AS place FROM c WHERE c_acctbal IS NOT NULL)"
    f" SELECT c_custkey, coalesce(c_acctbal, v) AS c_acctbal FROM c LEFT JOIN o ON c_acctbal IS NULL AND place = CAST(floor({_unit(_KEY, _BAL, seed=43)} * (SELECT count(*) FROM o)) AS BIGINT)"
)
SQL["source_split"] = f"""WITH x AS (SELECT c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_unit(_KEY)}, c_custkey) AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
    SELECT c_mktsegment, CASE WHEN i <= ceil(n * 0.25) THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM x GROUP BY 1, 2"""
SQL["select_low_deviation"] = "WITH d AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, stddev_samp({c}) AS score FROM lineitem" for c in _FEATURES) + ") SELECT feature, round(score, 6) AS score, score >= (SELECT quantile_cont(score, 0.25) FROM d) AS kept FROM d"
SQL["stats_partial_spearman"] = f"""WITH k AS ({_ranked(["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag", "lineitem")}), c AS (SELECT l_returnflag, corr(r0, r1) AS ab, corr(r0, r2) AS az, corr(r1, r2) AS bz FROM k GROUP BY 1)
    SELECT l_returnflag, round((ab - az * bz) / sqrt((1 - az * az) * (1 - bz * bz)), 6) AS rho FROM c"""
_STEPS = "c AS (SELECT f, v, count(*) FILTER (side = 0) AS cp, count(*) FILTER (side = 1) AS cq FROM l GROUP BY f, v), s AS (SELECT f, v, lead(v) OVER w AS nx, sum(cp) OVER w / CAST(sum(cp) OVER (PARTITION BY f) AS DOUBLE) AS fp, sum(cq) OVER w / CAST(sum(cq) OVER (PARTITION BY f) AS DOUBLE) AS fq FROM c WINDOW w AS (PARTITION BY f ORDER BY v)), w AS (SELECT f, sum(abs(fp - fq) * (nx - v)) AS w FROM s GROUP BY f)"
SQL["dist_distortion"] = f"""{_HIST}, {_STEPS}, m AS (SELECT f, var_pop(v) FILTER (side = 0) AS v0, var_pop(v) FILTER (side = 1) AS v1, skewness(v) FILTER (side = 0) AS s0, skewness(v) FILTER (side = 1) AS s1 FROM l GROUP BY f)
    SELECT round(0.3 * (SELECT avg(least(1, w / (3 * sqrt(v0)))) FROM w JOIN m USING (f)) + 0.25 * least(1, ({_DIST["jensen_shannon"].removeprefix(_HIST).replace("round(avg(v), 6)", "avg(v)")}) / sqrt(ln(2)))
      + 0.2 * least(1, ({_DIST["correlation_matrix"].replace("round(", "(").replace(", 6) AS value", ") AS value")}) / (2 * sqrt(3)))
      + (SELECT 0.15 * avg(least(1, abs(ln(v1 / v0)) / 2)) + 0.1 * avg(least(1, abs(s1 - s0) / (1 + abs(s0)))) FROM m), 6) AS value"""
_WHOLE = f"(SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM {CUSTOMER})"
_LEFT = f"(SELECT * FROM {_WHOLE} WHERE c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL)"
_THREE = ("c_custkey", "c_acctbal", "c_nationkey")
SQL["observer_quality"] = (
    "WITH l AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT {side} AS side, '{c}' AS f, CAST({c} AS DOUBLE) AS v FROM {source}" for side, source in ((0, _WHOLE), (1, _LEFT)) for c in _THREE) + f") WHERE v IS NOT NULL), {_STEPS},"
    f" t AS (SELECT f, stddev_pop(v) AS sd FROM l WHERE side = 0 GROUP BY f), g AS (SELECT c_mktsegment, count(*) AS n FROM {_LEFT} GROUP BY 1), k AS (SELECT f, skewness(v) AS s, kurtosis(v) AS k FROM l WHERE side = 1 GROUP BY f)"
    f" SELECT round((SELECT count(*) FROM {_LEFT}) / CAST((SELECT count(*) FROM {_WHOLE}) AS DOUBLE), 5) AS row_ratio, 1.0::DOUBLE AS column_ratio, 0.0::DOUBLE AS missing_mean, 0.0::DOUBLE AS missing_max, 0.0::DOUBLE AS duplicates,"
    " round((SELECT min(n) / CAST(max(n) AS DOUBLE) FROM g), 5) AS class_ratio, round((SELECT avg(abs(s)) FROM k), 5) AS skew, round((SELECT avg(k) FROM k), 5) AS kurtosis, round((SELECT avg(least(w / sd, 5)) FROM w JOIN t USING (f)), 5) AS drift"
)


def _linked(pairs: str, key: str, source: str, columns: str) -> str:
    """The rows that stay when all but the smallest key of each component of the pairs (a, b) go."""
    return f"""WITH RECURSIVE e AS MATERIALIZED ({pairs}), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), c(n, m) AS (SELECT a, a FROM u UNION SELECT u.b, c.m FROM c JOIN u ON u.a = c.n WHERE c.m < u.b)
        SELECT {columns} FROM {source} WHERE {key} NOT IN (SELECT n FROM c WHERE m < n)"""


SQL["dedup_approximate_blocked"] = _linked("SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey WHERE jaro_winkler_similarity(x.p_name, y.p_name) >= 0.85", "p_partkey", "part", "p_partkey")
SQL["dedup_sorted_neighbourhood"] = _linked(
    "SELECT DISTINCT x.p_partkey AS a, y.p_partkey AS b FROM (SELECT *, dense_rank() OVER (ORDER BY p_brand) AS g FROM part) x JOIN (SELECT *, dense_rank() OVER (ORDER BY p_brand) AS g FROM part) y"
    " ON abs(x.g - y.g) <= 1 AND x.p_partkey < y.p_partkey WHERE jaro_winkler_similarity(x.p_name, y.p_name) >= 0.85", "p_partkey", "part", "p_partkey")  # fmt: skip
SQL["dedup_row_metric"] = _linked("SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey WHERE damerau_levenshtein(x.n_name, y.n_name) < 0.3 * (length(x.n_name) + length(y.n_name)) / 2.0", "n_nationkey", "nation", "n_nationkey, n_name")
_WORDS = "(SELECT doc_id AS k, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda t: t <> '')) AS t FROM documents WHERE text IS NOT NULL)"
SQL["dedup_jaccard"] = _linked(
    f"SELECT a, b FROM (SELECT x.k AS a, y.k AS b, len(list_intersect(x.t, y.t)) AS c, len(x.t) AS m, len(y.t) AS n FROM {_WORDS} x JOIN {_WORDS} y ON x.k < y.k AND least(len(x.t), len(y.t)) >= 0.8 * greatest(len(x.t), len(y.t)) AND len(x.t) > 0) WHERE c >= (0.8 - 1e-12) * (m + n - c)", "doc_id", "documents", "doc_id")


_PART_UNIT = _unit("CAST(p_partkey AS VARCHAR)")
_BANDS = f"b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, CASE WHEN p_retailprice + p_size > 950 THEN 'high' ELSE 'low' END AS band, {_PART_UNIT} < 0.2 AS test FROM part)"
#: A score a row and class to the best class and its share, classes numbered in alphabetical order.
_BEST = """m AS (SELECT p_partkey, max(s) AS top, arg_max(i, s) AS i, arg_max(c, s) AS c FROM s GROUP BY 1), e AS (SELECT s.p_partkey, 1 / sum(exp(s.s - top)) AS confidence FROM s JOIN m USING (p_partkey) GROUP BY 1)"""
_NUMBERED = "CAST(CASE b.band WHEN 'high' THEN 0 ELSE 1 END AS DOUBLE) AS label, CAST(m.i AS DOUBLE) AS prediction, round(confidence, 6) AS confidence FROM b JOIN m USING (p_partkey) JOIN e USING (p_partkey)"
SQL["eval_gaussian_nb"] = f"""WITH {_BANDS}, v AS (SELECT 1e-9 * greatest(var_pop(x), var_pop(y)) AS eps FROM b WHERE NOT test),
    t AS (SELECT band AS c, CASE band WHEN 'high' THEN 0 ELSE 1 END AS i, ln(count(*)) - ln((SELECT count(*) FROM b WHERE NOT test)) AS p, avg(x) AS mx, avg(y) AS my, var_pop(x) + any_value(eps) AS vx, var_pop(y) + any_value(eps) AS vy FROM b, v WHERE NOT test GROUP BY 1),
    s AS (SELECT p_partkey, c, i, p - 0.5 * (ln(2 * pi() * vx) + power(x - mx, 2) / vx + ln(2 * pi() * vy) + power(y - my, 2) / vy) AS s FROM b, t WHERE test), {_BEST} SELECT b.p_partkey, {_NUMBERED}"""
SQL["eval_multinomial_nb"] = f"""WITH {_BANDS}, t AS (SELECT band AS c, CASE band WHEN 'high' THEN 0 ELSE 1 END AS i, ln(count(*) + 1.0) - ln((SELECT count(*) + 2.0 FROM b WHERE NOT test)) AS p, ln(sum(x) + 1) - ln(sum(x) + sum(y) + 2) AS tx, ln(sum(y) + 1) - ln(sum(x) + sum(y) + 2) AS ty FROM b WHERE NOT test GROUP BY 1),
    s AS (SELECT p_partkey, c, i, p + x * tx + y * ty AS s FROM b, t WHERE test), {_BEST} SELECT b.p_partkey, {_NUMBERED}"""
SQL["eval_lda"] = f"""WITH {_BANDS}, t AS (SELECT band AS c, 0 AS i, count(*) AS n, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy FROM b WHERE NOT test GROUP BY 1),
    g AS (SELECT sum(n) AS n, sum(n * xx) / (sum(n) - count(*)) + 1e-6 AS xx, sum(n * xy) / (sum(n) - count(*)) AS xy, sum(n * yy) / (sum(n) - count(*)) + 1e-6 AS yy FROM t),
    w AS (SELECT c, i, ln(t.n / g.n) AS p, mx, my, (g.yy * mx - g.xy * my) / (g.xx * g.yy - g.xy * g.xy) AS wx, (g.xx * my - g.xy * mx) / (g.xx * g.yy - g.xy * g.xy) AS wy FROM t, g),
    s AS (SELECT p_partkey, c, i, p - (mx * wx + my * wy) / 2 + x * wx + y * wy AS s FROM b, w WHERE test), {_BEST} SELECT b.p_partkey, b.band AS label, m.c AS prediction, round(confidence, 6) AS confidence FROM b JOIN m USING (p_partkey) JOIN e USING (p_partkey)"""
SQL["eval_linear_regression"] = f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_retailprice AS DOUBLE) END AS y, CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) END AS a, CAST(p_partkey % 100 AS DOUBLE) AS b, {_PART_UNIT} < 0.2 AS test FROM part),
    f AS (SELECT p_partkey, y, coalesce(a, (SELECT avg(a) FROM r WHERE y IS NOT NULL)) AS a, b, test FROM r WHERE y IS NOT NULL),
    g AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_ FROM f WHERE NOT test)
    SELECT p_partkey, y AS label, round(my + (a - ma) * (ay * bb - by_ * ab) / (aa * bb - ab * ab) + (b - mb) * (by_ * aa - ay * ab) / (aa * bb - ab * ab), 4) AS prediction FROM f, g WHERE test"""


# ---- what is asked for by name or as a base: calls, loaders, sinks, guards, parameterised operators, rewards


@query("base_call", SQL["impute_mean"])
def base_call(spark, sf):
    """Calling an operator that was not fitted: statistics of the frame itself."""
    return impute.MeanImputer(columns=["c_acctbal"])(customer(spark, sf)).select("c_custkey", r("c_acctbal").alias("c_acctbal"))


def _stored(spark, df: DataFrame, kind: str) -> str:
    from sievelake.plans.shared import fresh_dir

    return loaders.write_table(df, fresh_dir(spark, "tables"), "table", kind=kind)


@query("source_csv", "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, s_acctbal FROM supplier")
def source_csv(spark, sf):
    path = _stored(spark, table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "csv")
    return loaders.CSVLoader(spark, file_path=path.removeprefix("file://").removeprefix("file:")).load() if path.startswith("file:") else loaders.CSVLoader(spark, file_path=path).load()


@query("source_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def source_table(spark, sf):
    return loaders.TableLoader(spark, _stored(spark, table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal"), "orc"), kind="orc").load()


@query("source_load_all", "SELECT 'supplier' AS name, count(*) AS n FROM supplier")
def source_load_all(spark, sf):
    """The dataset that is not there is left out."""
    found = loaders.load_all({"supplier": loaders.CSVLoader(spark, dataset=table(spark, sf, "supplier")), "absent": loaders.TableLoader(spark, f"{sf}/absent.parquet", kind="parquet")})
    parts = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in found.items()]
    return parts[0]


@query("source_concat", "SELECT CAST(c_nationkey AS DOUBLE) AS nation, c_name AS name, c_custkey FROM customer UNION ALL SELECT s_nationkey, s_name, NULL FROM supplier")
def source_concat(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_name").alias("name"), "c_custkey", "c_acctbal")
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").cast("string").alias("nation"), F.col("s_name").alias("name"))
    return loaders.concat_tables([c, s], drop=("c_acctbal",), numbers=("nation",))


@query("source_train_test", f"SELECT CASE WHEN {_unit(_KEY)} < 0.33 THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM customer GROUP BY 1")
def source_train_test(spark, sf):
    made = loaders.train_test(table(spark, sf, "customer"), key=["c_custkey"], target="c_mktsegment")
    return made["train"].withColumn("part", F.lit("train")).unionByName(made["test"].withColumn("part", F.lit("test"))).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_parameterized", "SELECT max(p_partkey) AS p_partkey FROM part GROUP BY p_size")
def dedup_parameterized(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size")
    return dedup.ParameterizedDeduplicator(columns=["p_size"], key="p_partkey").set_params(keep="last").fit_transform(rows).select("p_partkey")


@query("outlier_guarded", "WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, round(value, 6) AS value FROM events, b WHERE value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)")
def outlier_guarded(spark, sf):
    inner = outliers.IQROutlierCleaner(columns=["value"], method="drop")
    return outliers.GuardedRemoval(inner=inner).fit_transform(table(spark, sf, "events")).select("event_id", r("value").alias("value"))


@query("outlier_guard_holds", "SELECT event_id FROM events")
def outlier_guard_holds(spark, sf):
    """A removal that would leave less than half of the rows is not made."""
    inner = outliers.ZScoreOutlierCleaner(columns=["value"], threshold=0.01, method="drop")
    return outliers.GuardedRemoval(inner=inner).fit_transform(table(spark, sf, "events")).select("event_id")


@query("scale_parameterized", "SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) AS value FROM events")
def scale_parameterized(spark, sf):
    return scale.ParameterizedScaler(columns=["value"]).set_params(method="zscore").fit_transform(table(spark, sf, "events").select("event_id", "value")).select("event_id", r("value").alias("value"))


@query("scale_skewed_log1p", "WITH s AS (SELECT avg(power(n_chars - m, 3)) / power(any_value(d), 3) AS s FROM documents, (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS d FROM documents)) SELECT doc_id, round(CASE WHEN s >= 0.75 THEN ln(1 + n_chars) ELSE n_chars END, 6) AS n_chars, CAST(doc_id AS DOUBLE) AS even FROM documents, s")
def scale_skewed_log1p(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.col("doc_id").cast("double").alias("even"))
    return scale.Log1pScaler(columns=["n_chars", "even"], min_skew=0.75).fit_transform(rows).select("doc_id", r("n_chars").alias("n_chars"), "even")


@query("inject_profile", SQL["inject_duplicates"])
def inject_profile(spark, sf):
    return inject.apply_error_profile(table(spark, sf, "customer"), inject.ErrorProfile("duplicates", 0.1), ["c_custkey"], "c_mktsegment")


@query("eval_confidence", f"SELECT round(avg(greatest(score, 1 - score)), 6) AS confidence, round(avg(abs(2 * score - 1)), 6) AS margin, round(avg(-(CASE WHEN score > 0 THEN score * ln(score) ELSE 0 END + CASE WHEN score < 1 THEN (1 - score) * ln(1 - score) ELSE 0 END)), 6) AS entropy FROM {_SCORED}")
def eval_confidence(spark, sf):
    rows = scored(spark, sf).select(F.array(F.col("score").cast("double"), 1 - F.col("score").cast("double")).alias("probability"))
    return evaluate.confidence_signals(rows).select(*(r(c).alias(c) for c in ("confidence", "margin", "entropy")))


class _ShareOver:
    """An evaluator of a closed form: the share of rows over a bound."""

    def __init__(self, column: str, bound: float):
        self.column, self.bound = column, bound

    def evaluate(self, df: DataFrame) -> float:
        return float(df.agg(F.avg((F.col(self.column) > self.bound).cast("double"))).first()[0] or 0.0)


_COMPLETE = "(1 - (count(*) FILTER (c_acctbal IS NULL) + count(*) FILTER (c_mktsegment IS NULL)) / CAST(4 * count(*) AS DOUBLE))"


@query(
    "reward_variants",
    f"""WITH w AS (SELECT count(*) AS n0, {_COMPLETE} AS c0 FROM {CUSTOMER}), l AS (SELECT count(*) AS n, avg(CASE WHEN c_acctbal > 0 THEN 1.0 ELSE 0.0 END) AS a FROM {_LEFT})
    SELECT 'accuracy' AS reward, round(a, 6) AS value FROM l UNION ALL SELECT 'completeness', round(sqrt(n / CAST(n0 AS DOUBLE)), 6) FROM l, w
    UNION ALL SELECT 'incremental', round(greatest(-1, least(1, 5 * (sqrt(n / CAST(n0 AS DOUBLE)) - c0))), 6) FROM l, w UNION ALL SELECT 'tiered', round(0.5 + a * sqrt(n / CAST(n0 AS DOUBLE)) - 0.005, 6) FROM l, w""",
)
def reward_variants(spark, sf):
    whole, share = customer(spark, sf), _ShareOver("c_acctbal", 0.0)
    prepared = impute.DropMissing().transform(whole)
    own = {"accuracy": reward.AccuracyReward(share), "completeness": reward.CompletenessRetentionReward(), "incremental": reward.IncrementalGainReward(reward.CompletenessRetentionReward()), "tiered": reward.TieredAccuracyReward(share)}
    for x in own.values():
        x.reset(whole)
    return spark.createDataFrame([(name, round(float(x(prepared)), 6)) for name, x in own.items()], "reward string, value double")


SQL["profile_dataset"] = f"""WITH p AS ({" UNION ALL ".join(_rates(c) for c in _THREE)}), n AS (SELECT count(*) AS n FROM {CUSTOMER}), g AS (SELECT c_mktsegment, count(*) AS c FROM {CUSTOMER} GROUP BY 1),
    v AS (SELECT avg(missing) AS m, avg(iqr_rate) AS i, avg(z_rate) AS z, avg(abs_skew) AS s, avg("distinct" / CAST(n AS DOUBLE)) AS d FROM p, n)
    SELECT concat_ws(',', CASE WHEN m > 0.005 THEN 'imputation' END, CASE WHEN greatest(i, z) > 0.005 THEN 'outlier_detection' END, CASE WHEN s > 0.005 THEN 'scaling' END) AS groups,
           CAST(n AS DOUBLE) AS n_rows, 3.0::DOUBLE AS n_columns, round(m, 4) AS missing, 0.0::DOUBLE AS duplicates, round(i, 4) AS iqr_rate, round(z, 4) AS z_rate, round(s, 4) AS skew, round(d, 4) AS cardinality,
           round(1 - (SELECT max(c) / CAST(sum(c) AS DOUBLE) FROM g), 4) AS imbalance FROM v, n"""


_PREPARED = {
    "mean": "(SELECT * REPLACE (coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {q})) AS c_acctbal) FROM {q})",
    "median": "(SELECT * REPLACE (coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {q})) AS c_acctbal) FROM {q})",
    "iqr": "(SELECT * FROM {q} WHERE c_acctbal IS NULL OR c_acctbal BETWEEN (SELECT 2.5 * quantile_cont(c_acctbal, 0.25) - 1.5 * quantile_cont(c_acctbal, 0.75) FROM {q}) AND (SELECT 2.5 * quantile_cont(c_acctbal, 0.75) - 1.5 * quantile_cont(c_acctbal, 0.25) FROM {q}))",
    "minmax": "(SELECT * REPLACE ((c_acctbal - (SELECT min(c_acctbal) FROM {q})) / (SELECT max(c_acctbal) - min(c_acctbal) FROM {q}) AS c_acctbal) FROM {q})",
}


def _scored_pipeline(*steps: str) -> str:
    """SQL of the completeness and retention of the customers after these steps."""
    q = _WHOLE
    for step in steps:
        q = _PREPARED[step].format(q=q)
    return f"(SELECT {_COMPLETE} * sqrt(count(*) / CAST((SELECT count(*) FROM {_WHOLE}) AS DOUBLE)) FROM {q})"


_ORDERS = [(), *((a,) for a in _PREPARED), *((a, b) for a in _PREPARED for b in _PREPARED if a != b and {a, b} != {"mean", "median"})]
SQL["search_best_pipeline"] = " UNION ALL ".join(f"SELECT '{' > '.join(p) or 'none'}' AS pipeline, 'completeness' AS reward, round({_scored_pipeline(*p)}, 6) AS value, CAST(NULL AS VARCHAR) AS error" for p in _ORDERS)
SQL["search_sequential_env"] = f"""SELECT 0 AS step, round({_scored_pipeline("mean")} - {_scored_pipeline()}, 6) AS reward, false AS terminated
    UNION ALL SELECT 1, round({_scored_pipeline("mean", "iqr")} - {_scored_pipeline("mean")}, 6), false UNION ALL SELECT 2, -1.0, true"""
SQL["search_greedy"] = f"""WITH s AS (SELECT {_scored_pipeline()} AS none, {_scored_pipeline("mean")} AS mean, {_scored_pipeline("median")} AS median),
    i AS (SELECT CASE WHEN none >= greatest(mean, median) THEN NULL WHEN mean >= median THEN 'mean' ELSE 'median' END AS action, greatest(none, mean, median) AS score FROM s)
    SELECT 'imputation' AS family, action, round(score, 6) AS score FROM i
    UNION ALL SELECT 'outliers', CASE WHEN (CASE action WHEN 'mean' THEN {_scored_pipeline("mean", "iqr")} WHEN 'median' THEN {_scored_pipeline("median", "iqr")} ELSE {_scored_pipeline("iqr")} END) > score + 1e-12 THEN 'iqr' END, round(score, 6) FROM i
    UNION ALL SELECT 'scaling', NULL, round(score, 6) FROM i"""
#: The 2 x 3 nearest of a value's own class follow from the ranks of the class; what is nearer than the third of any class is counted over all pairs.
SQL["select_mutual_info_neighbours"] = f"""WITH b AS (SELECT p_partkey AS k, p_partkey % 3 + CAST(p_retailprice + p_size > 950 AS INT) AS y, CAST(p_size AS DOUBLE) AS p_size, CAST(p_retailprice AS DOUBLE) AS p_retailprice FROM part),
    l AS (SELECT 'p_size' AS feature, k, y, p_size + (2 * {_unit("CAST(k AS VARCHAR)")} - 1) * (1e-10 * (SELECT greatest(stddev_pop(p_size), avg(abs(p_size))) FROM b)) AS v FROM b
          UNION ALL SELECT 'p_retailprice', k, y, p_retailprice + (2 * {_unit("CAST(k AS VARCHAR)", seed=43)} - 1) * (1e-10 * (SELECT greatest(stddev_pop(p_retailprice), avg(abs(p_retailprice))) FROM b)) FROM b),
    c AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS size FROM l QUALIFY size > 1),
    w AS (SELECT *, list_sort(list_transform(list_filter([lag(v, 1) OVER o, lag(v, 2) OVER o, lag(v, 3) OVER o, lead(v, 1) OVER o, lead(v, 2) OVER o, lead(v, 3) OVER o], lambda x: x IS NOT NULL), lambda x: abs(x - v)))[least(3, size - 1)] AS r
          FROM c WINDOW o AS (PARTITION BY feature, y ORDER BY v)),
    m AS (SELECT w.feature, w.k, any_value(w.size) AS size, count(*) AS m FROM w JOIN c ON c.feature = w.feature AND abs(c.v - w.v) < w.r GROUP BY 1, 2),
    psi AS (SELECT n, -0.5772156649015329 + coalesce(sum(1.0 / (n - 1)) FILTER (n > 1) OVER (ORDER BY n), 0) AS psi FROM range(1, (SELECT count(*) + 2 FROM part)) t(n)),
    s AS (SELECT feature, greatest(0, (SELECT psi FROM psi WHERE n = max(total)) + avg(k.psi - z.psi - g.psi)) AS score
          FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS total FROM m) m JOIN psi k ON k.n = least(3, size - 1) JOIN psi z ON z.n = size JOIN psi g ON g.n = m GROUP BY feature)
    SELECT feature, round(score, 6) AS score, score = max(score) OVER () AS kept FROM s"""
#: Sums of all folds but one, by fold.
_FOLDS = f"""b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_retailprice AS DOUBLE) AS y, CASE WHEN p_retailprice + p_size > 950 THEN 'high' ELSE 'low' END AS band, CAST(floor({_unit("CAST(p_partkey AS VARCHAR)", "'fold'")} * 10) AS INTEGER) AS fold FROM part), f AS (SELECT DISTINCT fold FROM b)"""
SQL["eval_kfold_nb"] = f"""WITH {_FOLDS}, t AS (SELECT f.fold, band AS c, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS vx, var_pop(y) AS vy FROM f JOIN b ON b.fold <> f.fold GROUP BY 1, 2),
    v AS (SELECT f.fold, 1e-9 * greatest(var_pop(x), var_pop(y)) AS eps, count(*) AS total FROM f JOIN b ON b.fold <> f.fold GROUP BY 1),
    s AS (SELECT b.fold, p_partkey, band, c, ln(n / total) - 0.5 * (ln(2 * pi() * (vx + eps)) + power(x - mx, 2) / (vx + eps) + ln(2 * pi() * (vy + eps)) + power(y - my, 2) / (vy + eps)) AS s FROM b JOIN t USING (fold) JOIN v USING (fold)),
    m AS (SELECT fold, p_partkey, any_value(band) AS band, arg_max(c, s) AS p FROM s GROUP BY 1, 2)
    SELECT 0 AS point, fold, count(*) AS n, count(*) FILTER (band = p) AS hits FROM m GROUP BY fold"""
SQL["eval_kfold_ols"] = f"""WITH {_FOLDS}, t AS (SELECT f.fold, regr_slope(y, x) AS a, regr_intercept(y, x) AS i FROM f JOIN b ON b.fold <> f.fold GROUP BY 1)
    SELECT fold, count(*) AS n, round(avg(power(y - i - a * x, 2)), 4) AS mse FROM b JOIN t USING (fold) GROUP BY fold"""
SQL["eval_lda_nulls"] = SQL["eval_lda"].replace(_BANDS, f"""o AS (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS x, CAST(p_retailprice AS DOUBLE) AS y, CASE WHEN p_retailprice + p_size > 950 THEN 'high' ELSE 'low' END AS band, {_PART_UNIT} < 0.2 AS test FROM part),
    b AS (SELECT p_partkey, coalesce(x, (SELECT avg(x) FROM o WHERE NOT test)) AS x, y, band, test FROM o)""")


@query(
    "inject_mcar_cells",
    f"""WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer), n AS (SELECT count(*) AS n FROM customer),
        h AS (SELECT DISTINCT CAST(floor({_unit("CAST(i AS VARCHAR)")} * n * 2) AS BIGINT) AS cell FROM n, (SELECT unnest(range(0, (SELECT CAST(greatest(1, round(n * 2 * 0.1)) AS BIGINT) FROM n))) AS i))
        SELECT c_custkey, CASE WHEN 2 * k NOT IN (SELECT cell FROM h) THEN c_acctbal END AS c_acctbal, CASE WHEN 2 * k + 1 NOT IN (SELECT cell FROM h) THEN c_nationkey END AS c_nationkey FROM c""",
)
def inject_mcar_cells(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return inject.inject_mcar_cells(rows, 0.1, ["c_custkey"], ["c_acctbal", "c_nationkey"])


@query(
    "dedup_lsh_links",
    """WITH t AS (SELECT p_partkey AS k, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS s FROM part),
       e AS (SELECT s, min(k) AS a FROM t GROUP BY s) SELECT a, k AS b, 1.0 AS jaccard FROM e JOIN t USING (s) WHERE k <> a""",
)
def dedup_lsh_links(spark, sf):
    """At a threshold that only equal sets of words reach the answer is known."""
    return dedup.lsh_links(dedup.token_sets(table(spark, sf, "part"), "p_partkey", F.col("p_name")), 0.999)


@query("dedup_lsh_documents")
def dedup_lsh_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.lsh_links(dedup.token_sets(docs, "doc_id", F.col("text")), 0.8).withColumn("jaccard", r("jaccard"))


@query("stream_profiles", "SELECT user_id, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def stream_profiles(spark, sf):
    """Keyed state over the table as a stream; the profile of most rows is a key's latest."""
    from sievelake.streaming import streams

    stream = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.run_to_table(streams.running_profiles(stream, "user_id", "ts", "value", "3650 days", "3650 days"), "update")
    last = found.groupBy("user_id").agg(F.max_by(F.struct("n", "mean", "sd", "least", "most"), "n").alias("p"))
    return last.select("user_id", "p.n", r("p.mean", 4).alias("mean"), r("p.sd", 4).alias("sd"), "p.least", "p.most")


@query("table_function_items", "SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS place, round(CAST(unnest(embedding) AS DOUBLE), 6) AS value FROM embeddings")
def table_function_items(spark, sf):
    from sievelake.streaming import streams

    return streams.items(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").withColumn("value", r("value"))


@query("search_mixture")
def search_mixture(spark, sf):
    """The shares of the candidates of each stage, and which is chosen."""
    rows = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("c_acctbal"), "c_nationkey", (F.col("c_acctbal") + 100 * F.col("c_nationkey")).alias("y"))
    found = mixture.PipelineMixture(["c_acctbal", "c_nationkey"], "y", ["c_custkey"], steps=25).fit(rows)
    return spark.createDataFrame([(stage, name, round(float(p), 4), found.chosen[stage] == name) for stage, shares in found.shares.items() for name, p in zip(mixture.STAGES[stage], shares, strict=True)], "stage string, candidate string, share double, chosen boolean")


@query(
    "dedup_levenshtein_names",
    f"SELECT * FROM (SELECT x.k AS a, y.k AS b, round(1 - levenshtein(x.v, y.v) / CAST(greatest(length(x.v), length(y.v)) AS DOUBLE), 6) AS similarity FROM {_NAMES} x JOIN {_NAMES} y ON x.k < y.k) WHERE similarity >= 0.6",
)
def dedup_levenshtein_names(spark, sf):
    names = table(spark, sf, "part").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    return dedup.ApproximateDeduplicator(key="k", comparison_type="levenshtein", threshold=0.6).links(names.select("k", "p_name"), ["p_name"]).select("a", "b", r("similarity").alias("similarity"))


@query(
    "stats_pareto_three",
    """SELECT s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_acctbal >= a.s_acctbal AND b.s_nationkey >= a.s_nationkey AND b.s_suppkey % 17 >= a.s_suppkey % 17
       AND (b.s_acctbal > a.s_acctbal OR b.s_nationkey > a.s_nationkey OR b.s_suppkey % 17 > a.s_suppkey % 17))""",
)
def stats_pareto_three(spark, sf):
    rows = table(spark, sf, "supplier").withColumn("third", F.col("s_suppkey") % 17)
    return evaluate.pareto_front(rows, "s_suppkey", ["s_acctbal", "s_nationkey", "third"]).select("s_suppkey")


# ---- contracts of operators, loaders and searches


@query("action_parameters", "SELECT event_id, round(value + 1, 6) AS usual, round(value + 2.5, 6) AS given FROM events")
def action_parameters(spark, sf):
    """A class's defaults, overridden by keyword."""
    rows = table(spark, sf, "events").select("event_id", F.col("value").alias("usual"), F.col("value").alias("given"))
    rows = base.DummyAdd(columns=["usual"]).fit_transform(rows)
    return base.DummyAdd(columns=["given"], increment=2.5).fit_transform(rows).select("event_id", r("usual").alias("usual"), r("given").alias("given"))


@query("action_unfitted", "SELECT event_id, round((value - avg(value) OVER ()) / stddev_pop(value) OVER (), 6) AS value FROM events WHERE event_id % 2 = 0")
def action_unfitted(spark, sf):
    """Without a fit the statistics are those of the frame itself."""
    return scale.ZScoreScaler(columns=["value"]).transform(table(spark, sf, "events").where("event_id % 2 = 0").select("event_id", "value")).withColumn("value", r("value"))


@query("action_excluded", f"SELECT c_custkey, c_acctbal, c_mktsegment, CAST(c_nationkey AS DOUBLE) / 24 AS c_nationkey FROM {CUSTOMER}")
def action_excluded(spark, sf):
    """Numbers alone, without the excluded ones."""
    rows = customer(spark, sf)
    return scale.MinMaxScaler(exclude=["c_custkey", "c_acctbal"]).fit_transform(rows).select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")


_SEGMENTS = {"columns": {"c_acctbal": {"nullable": False, "checks": {"in_range": [0, 10000]}}, "c_mktsegment": {"nullable": True, "checks": {"isin": ["BUILDING", "MACHINERY"]}}}}


@query(
    "validate_after_transform",
    f"""WITH f AS (SELECT coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {CUSTOMER})) AS a, c_mktsegment AS s FROM {CUSTOMER})
        SELECT 'c_acctbal:in_range' AS "check", count(*) FILTER (NOT a BETWEEN 0 AND 10000) AS failed, true AS refused FROM f UNION ALL SELECT 'c_acctbal:nullable', count(*) FILTER (a IS NULL), true FROM f
        UNION ALL SELECT 'c_mktsegment:isin', count(*) FILTER (s NOT IN ('BUILDING', 'MACHINERY')), true FROM f""",
)
def validate_after_transform(spark, sf):
    rows = customer(spark, sf)
    warned = validate.Validated(impute.MeanImputer(columns=["c_acctbal"]), _SEGMENTS, "warn").fit(rows)
    try:
        validate.Validated(impute.MeanImputer(columns=["c_acctbal"]), _SEGMENTS).fit_transform(rows)
        refused = False
    except base.DataValidationError:
        refused = True
    return warned.validator.violations(warned.transform(rows)).withColumn("refused", F.lit(refused))


@query("complete_numbers", f"SELECT c_custkey, c_acctbal, c_nationkey FROM {CUSTOMER} WHERE c_acctbal IS NOT NULL AND (SELECT count(c_acctbal) FROM {CUSTOMER}) >= 20")
def complete_numbers(spark, sf):
    return base.complete_numbers(customer(spark, sf), ["c_custkey"], 20)


@query(
    "join_columns",
    f"SELECT a.c_custkey, a.c_nationkey, m.c_acctbal, l.c_mktsegment FROM {CUSTOMER} a LEFT JOIN (SELECT c_custkey, coalesce(c_acctbal, 0) AS c_acctbal FROM {CUSTOMER}) m USING (c_custkey) LEFT JOIN (SELECT c_custkey, c_mktsegment FROM {CUSTOMER} WHERE c_mktsegment IS NOT NULL) l USING (c_custkey)",
)
def join_columns(spark, sf):
    """Groups of columns that different operators have prepared, side by side."""
    rows = customer(spark, sf)
    numbers = impute.ZeroImputer(columns=["c_acctbal"]).fit_transform(rows.select("c_custkey", "c_acctbal"))
    texts = impute.DropMissing(columns=["c_mktsegment"]).fit_transform(rows.select("c_custkey", "c_mktsegment"))
    return base.join_columns([rows.select("c_custkey", "c_nationkey"), numbers, texts], ["c_custkey"])


@query("concat_columns", f"SELECT c_custkey, a.c_acctbal, b.c_mktsegment FROM (SELECT * FROM {CUSTOMER} WHERE c_acctbal > 0) a FULL JOIN (SELECT * FROM {CUSTOMER} WHERE c_custkey % 2 = 0) b USING (c_custkey)")
def concat_columns(spark, sf):
    rows = customer(spark, sf)
    return base.concat_columns([rows.where("c_acctbal > 0").select("c_custkey", "c_acctbal"), rows.where("c_custkey % 2 = 0").select("c_custkey", "c_mktsegment")], ["c_custkey"])


@query("outlier_iqr_zero_guard", "WITH b AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events) SELECT event_id, value FROM events, b WHERE value BETWEEN a - 1.5 * (c - a) AND c + 1.5 * (c - a)")
def outlier_iqr_zero_guard(spark, sf):
    """A constant column has no range and so no bounds."""
    rows = table(spark, sf, "events").select("event_id", "value", F.when(F.col("event_id") < 3, 100.0).otherwise(1.0).alias("flat"))
    return outliers.GuardedIQRCleaner(columns=["value", "flat"]).fit_transform(rows).select("event_id", "value")


for _clamp, _scale, _low, _high, _middle, _width in (
    ("sd3", "standard", "avg(v) - 3 * stddev_pop(v)", "avg(v) + 3 * stddev_pop(v)", "avg(v)", "stddev_pop(v)"),
    ("iqr", "robust", "2.5 * quantile_cont(v, 0.25) - 1.5 * quantile_cont(v, 0.75)", "2.5 * quantile_cont(v, 0.75) - 1.5 * quantile_cont(v, 0.25)", "median(v)", "quantile_cont(v, 0.75) - quantile_cont(v, 0.25)"),
    ("iqr", "minmax", "2.5 * quantile_cont(v, 0.25) - 1.5 * quantile_cont(v, 0.75)", "2.5 * quantile_cont(v, 0.75) - 1.5 * quantile_cont(v, 0.25)", "min(v)", "max(v) - min(v)"),
):

    @query(f"clamp_{_clamp}_{_scale}", f"WITH e AS (SELECT event_id, value AS v FROM events), c AS (SELECT event_id, greatest(least(v, (SELECT {_high} FROM e)), (SELECT {_low} FROM e)) AS v FROM e) SELECT event_id, round((v - (SELECT {_middle} FROM c)) / (SELECT {_width} FROM c), 6) AS value FROM c")
    def _(spark, sf, clamp=_clamp, scaling=_scale):
        return outliers.ClampNormaliser(columns=["value"], clamp=clamp, scale=scaling).fit_transform(table(spark, sf, "events").select("event_id", "value")).withColumn("value", r("value"))


@query("source_one_split", "SELECT * FROM nation")
def source_one_split(spark, sf):
    return loaders.LocalDatasetLoader(spark, sf, split="nation.parquet").load()


@query("source_downloaded", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_name IN ('Supplier#000000003', 'Supplier#000000007') THEN NULL ELSE s_name END AS known FROM supplier")
def source_downloaded(spark, sf):
    """The table as a csv in the shared folder, read as a download, with two marks of missing names."""
    folder = fresh_dir(spark, "download")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.col("s_name").alias("known"))
    rows.write.option("header", True).csv(f"{folder}/supplier.csv")
    found = loaders.DownloadedCSVLoader(spark, "suppliers", folder, "supplier.csv", read_csv_kwargs={"na_values": ["Supplier#000000003", "Supplier#000000007"]}).load()
    return found.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.coalesce("s_name", F.format_string("Supplier#%09d", F.col("s_suppkey"))).alias("s_name"), "s_nationkey", "known")


@query("source_cached_table", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS p_brand, nullif(p_size, 1) AS p_size FROM part")
def source_cached_table(spark, sf):
    """Chosen zeros are null, strings ordinal codes."""
    folder = fresh_dir(spark, "cache")
    table(spark, sf, "part").select("p_partkey", "p_brand", (F.col("p_size") - 1).alias("p_size")).write.parquet(f"{folder}/part.parquet")
    found = loaders.CachedTableLoader(spark, "part", folder, "p_size", ("p_size",)).load()
    return found.select("p_partkey", F.col("p_brand").cast("long").alias("p_brand"), (F.col("p_size") + 1).alias("p_size"))


@query("search_permutations_env", f"SELECT 'mean > iqr' AS pipeline, round({_scored_pipeline('mean', 'iqr')}, 6) AS reward, true AS terminated UNION ALL SELECT 'minmax', round({_scored_pipeline('minmax')}, 6), true")
def search_permutations_env(spark, sf):
    """One step is a whole pipeline."""
    rows = customer(spark, sf)
    own = [_groups()["imputation"][0], _groups()["outliers"][0], _groups()["scaling"][0]]
    env = search.PermutationsCleaningEnv(rows, own, _scorer(rows))
    names = {tuple(a.name for a in env.space.unrank(i)): i for i in range(len(env.space))}
    steps = [env.step(names[n]) for n in (("mean", "iqr"), ("minmax",))]
    return spark.createDataFrame([(" > ".join(s.info["pipeline"]), round(float(s.reward), 6), s.terminated) for s in steps], "pipeline string, reward double, terminated boolean")


@query("search_penalised_env", f"SELECT 0 AS step, round({_scored_pipeline('mean')} - {_scored_pipeline()}, 6) AS reward, false AS terminated UNION ALL SELECT 1, -0.05, false UNION ALL SELECT 2, round({_scored_pipeline('mean', 'minmax')} - {_scored_pipeline('mean')}, 6), false")
def search_penalised_env(spark, sf):
    """A repeat costs 0.05 and the episode goes on."""
    rows = customer(spark, sf)
    env = search.PenalisedCleaningEnv(rows, [a for own in _groups().values() for a in own], _scorer(rows))
    env.reset()
    steps = [env.step(i) for i in (0, 0, 3)]
    return spark.createDataFrame([(i, round(float(s.reward), 6), s.terminated) for i, s in enumerate(steps)], "step int, reward double, terminated boolean")


@query("search_random_cleaning", f"SELECT 'iqr > minmax' AS pipeline, round({_scored_pipeline('iqr', 'minmax')}, 6) AS score")
def search_random_cleaning(spark, sf):
    """One drawn operator of each family; families of one leave no choice."""
    rows = customer(spark, sf)
    names, value = search.random_cleaning(rows, {k: v for k, v in _groups().items() if len(v) == 1}, _scorer(rows))
    return spark.createDataFrame([(" > ".join(names), round(float(value), 6))], "pipeline string, score double")


@query("search_offline_transitions")
def search_offline_transitions(spark, sf):
    rows = customer(spark, sf)
    own = search.OfflineTransitions(search.SequentialCleaningEnv(rows, [a for v in _groups().values() for a in v], _scorer(rows), profile.DataStatsObserver()))
    own.collect(2)
    return own.frame(spark).select("action", F.round("reward", 6).alias("reward"), "done")


@query("search_nested")
def search_nested(spark, sf):
    """The best pipeline by inner validation, scored on rows that no fit has seen."""
    rows = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"), "p_retailprice")
    pipelines = [[impute.MeanImputer(columns=["p_size"], name="mean")], [impute.ZeroImputer(columns=["p_size"], name="zero"), outliers.IQROutlierCleaner(columns=["p_size"], method="clip", name="iqr")]]

    def error(train, held):
        slope, middle = train.agg(F.regr_slope("p_retailprice", "p_size"), F.regr_intercept("p_retailprice", "p_size")).first()
        return -float(held.agg(F.avg(F.abs(F.col("p_retailprice") - F.lit(middle) - F.lit(slope) * F.col("p_size")))).first()[0])

    best, inner, outer = search.NestedProtocol(["p_partkey"]).choose(rows, pipelines, error)
    return spark.createDataFrame([(" > ".join(a.name for a in best), round(inner, 6), round(outer, 6))], "pipeline string, validation double, test double")


@query(
    "search_expanded_grid",
    " UNION ALL ".join(f"SELECT {f} AS factor, (SELECT count(*) FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS c FROM events) WHERE value BETWEEN a - {f} * (c - a) AND c + {f} * (c - a)) AS kept" for f in (1.0, 2.0, 3.0)),
)
def search_expanded_grid(spark, sf):
    """Every point of an operator's grid, and how many rows it keeps."""
    rows = table(spark, sf, "events").select("event_id", "value")
    grid = [outliers.IQROutlierCleaner(columns=["value"], method="drop", factor=f) for f in base.ParamSpec("factor", "float", 1.0, 3.0).grid(3)]
    kept = None
    for a in base.fit_together(rows, grid):
        one = a.transform(rows).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(a.params["factor"]).alias("factor"), "kept")
        kept = one if kept is None else kept.unionByName(one)
    return kept


@query("registry_strategies", f"SELECT 'MEAN' AS name, round(sum(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM {CUSTOMER}))), 2) AS total FROM {CUSTOMER} UNION ALL SELECT 'MEDIAN', round(sum(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM {CUSTOMER}))), 2) FROM {CUSTOMER}")
def registry_strategies(spark, sf):
    """Operators by the names that the dict interface knows them by."""
    from sievelake.plans import registry

    made = {name: registry.apply_to_dataset("imputation", name, {"train": customer(spark, sf), "test": None}, columns=["c_acctbal"])["train"] for name in ("MEAN", "MEDIAN")}
    one = lambda name: made[name].agg(r(F.sum("c_acctbal"), 2).alias("total")).select(F.lit(name).alias("name"), "total")
    return one("MEAN").unionByName(one("MEDIAN"))


SQL["search_permutations"] = " UNION ALL ".join(f"SELECT '{' > '.join(p)}' AS pipeline, round({_scored_pipeline(*p)}, 6) AS value" for n in (1, 2, 3) for p in permutations(("mean", "iqr", "minmax"), n))


@query("encode_frequency", f"SELECT c_custkey, c_mktsegment AS segment, round(CASE WHEN c_mktsegment IS NOT NULL THEN count(*) OVER (PARTITION BY c_mktsegment) / CAST((SELECT count(c_mktsegment) FROM {CUSTOMER}) AS DOUBLE) END, 6) AS c_mktsegment FROM {CUSTOMER}")
def encode_frequency(spark, sf):
    rows = customer(spark, sf).select("c_custkey", F.col("c_mktsegment").alias("segment"), "c_mktsegment")
    return scale.FrequencyEncoder(columns=["c_mktsegment"]).fit_transform(rows).withColumn("c_mktsegment", r("c_mktsegment"))


@query("encode_dummies", f"SELECT c_custkey, {', '.join(f'CAST(coalesce(c_mktsegment = {v!r}, false) AS INTEGER) AS c_mktsegment_{v.lower()}' for v in ('AUTOMOBILE', 'BUILDING'))} FROM {CUSTOMER}")
def encode_dummies(spark, sf):
    coded = scale.DummyCoder(columns=["c_mktsegment"]).fit_transform(customer(spark, sf).select("c_custkey", "c_mktsegment"))
    return coded.select("c_custkey", F.col("c_mktsegment_AUTOMOBILE").alias("c_mktsegment_automobile"), F.col("c_mktsegment_BUILDING").alias("c_mktsegment_building"))


@query("impute_default", f"SELECT c_custkey, coalesce(c_acctbal, -1) AS c_acctbal, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM {CUSTOMER}")
def impute_default(spark, sf):
    return impute.DefaultImputer(number=-1, text="none").fit_transform(customer(spark, sf)).select("c_custkey", "c_acctbal", "c_mktsegment")


@query("balance_undersample", f"SELECT c_custkey, c_mktsegment FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_unit('CAST(c_custkey AS VARCHAR)')}) AS i FROM {CUSTOMER} WHERE c_mktsegment IS NOT NULL) WHERE i <= (SELECT min(n) FROM (SELECT count(*) AS n FROM {CUSTOMER} WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment))")
def balance_undersample(spark, sf):
    return reduce.Undersampler(key="c_custkey", target="c_mktsegment").fit_transform(customer(spark, sf)).select("c_custkey", "c_mktsegment")


@query(
    "quality_components",
    """WITH d AS (SELECT CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal / 100) END AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer), c AS (SELECT a, b FROM d WHERE b < 20),
       s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, count(*) AS n, count(a) AS k FROM c),
       o AS (SELECT count(*) FILTER (abs(a - ma) / (sa + 1e-9) > 3) + count(*) FILTER (abs(b - mb) / (sb + 1e-9) > 3) AS o FROM c, s),
       v AS (SELECT 'a' AS f, a AS v, 0 AS side FROM c WHERE a IS NOT NULL UNION ALL SELECT 'a', a, 1 FROM d WHERE a IS NOT NULL UNION ALL SELECT 'b', b, 0 FROM c UNION ALL SELECT 'b', b, 1 FROM d),
       g AS (SELECT f, v, count(*) FILTER (side = 0) AS p, count(*) FILTER (side = 1) AS q FROM v GROUP BY 1, 2),
       w AS (SELECT f, lead(v) OVER x - v AS width, sum(p) OVER x / CAST(sum(p) OVER (PARTITION BY f) AS DOUBLE) AS fp, sum(q) OVER x / CAST(sum(q) OVER (PARTITION BY f) AS DOUBLE) AS fq FROM g WINDOW x AS (PARTITION BY f ORDER BY v)),
       m AS (SELECT f, sum(abs(fp - fq) * width) AS w FROM w GROUP BY 1),
       r AS (SELECT avg(w / (CASE f WHEN 'a' THEN (SELECT stddev_pop(a) FROM d) ELSE (SELECT stddev_pop(b) FROM d) END + 1e-9)) AS drift FROM m),
       t AS (SELECT n / CAST((SELECT count(*) FROM d) AS DOUBLE) AS retention, (SELECT count(*) FROM (SELECT DISTINCT a, b FROM c)) / CAST(n AS DOUBLE) AS uniqueness, 1 - o / (2.0 * n) AS outlier_free, (1 - (1 - k / CAST(n AS DOUBLE)) / 2) * (1 - least(drift, 1)) AS q FROM s, o, r)
       SELECT round(retention, 6) AS retention, round(uniqueness, 6) AS uniqueness, round(outlier_free, 6) AS outlier_free, round((retention + uniqueness + outlier_free) / 3, 6) AS composite, round(q, 6) AS observer_quality FROM t""",
)
def quality_components(spark, sf):
    dirty = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.round(F.col("c_acctbal") / 100)).alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    found = profile.quality_components(dirty.where("b < 20"), dirty)
    return found.select(*(r(c).alias(c) for c in found.columns))
