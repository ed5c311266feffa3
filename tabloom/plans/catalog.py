"""The catalog of queries: name to plan, and name to the same result in SQL where SQL can express it.

Doubles are rounded on both sides, since sums depend on their order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import number
from ..operators import clean, convert, drift, encode, expand, impute, metrics, profile, report, sample, select, shap, train, tune
from ..sources.tables import load
from ..streaming import apply

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, **special: int) -> DataFrame:
    doubles = {f.name for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.round(F.col(f"`{c}`").cast("double"), special.get(c, places)).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns])


def table_of(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- profiling ----

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
_KIND = {"l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string"}


@query(
    "base_information",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, '{_KIND.get(c, 'bigint')}' AS dtype, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 6)::DOUBLE AS pct_missing, "
        f"count(DISTINCT {c}) AS n_unique, count({c}) AS n FROM lineitem"
        for c in _LINE
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.base_information(load(spark, d, "lineitem").select(*_LINE)))


@query(
    "base_information_nulls",
    "WITH o AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p, CASE WHEN o_orderkey % 5 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS t FROM orders), "
    "q AS (SELECT p, CASE WHEN isnan(t) THEN NULL ELSE t END AS t FROM o) "
    "SELECT 'p' AS feature, 'string' AS dtype, count(*) - count(p) AS n_missing, round(100.0 * (count(*) - count(p)) / count(*), 6)::DOUBLE AS pct_missing, count(DISTINCT p) AS n_unique, count(p) AS n FROM q "
    "UNION ALL SELECT 't', 'double', count(*) - count(t), round(100.0 * (count(*) - count(t)) / count(*), 6)::DOUBLE, count(DISTINCT t), count(t) FROM q",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    return rounded(
        profile.base_information(
            o.select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderpriority")).alias("p"), F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("t"))
        )
    )


def _describe_sql(c: str, table: str, places: int = 4) -> str:
    r = lambda x: f"round({x}, {places})"
    return (
        f"SELECT count({c}) AS count, {r(f'avg({c})')} AS mean, {r(f'stddev({c})')} AS std, {r(f'min({c})')} AS min, {r(f'quantile_cont({c}, 0.05)')} AS p05, {r(f'quantile_cont({c}, 0.25)')} AS q1, "
        f"{r(f'median({c})')} AS median, {r(f'quantile_cont({c}, 0.75)')} AS q3, {r(f'quantile_cont({c}, 0.95)')} AS p95, {r(f'max({c})')} AS max, round(variance({c}), 0) AS variance, "
        f"{r(f'skewness({c})')} AS skewness, {r(f'kurtosis({c})')} AS kurtosis, count(*) - count({c}) AS missing, {r(f'100.0 * (count(*) - count({c})) / count(*)')}::DOUBLE AS missing_pct FROM {table}"
    )


@query("describe_numerical", _describe_sql("l_extendedprice", "lineitem"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.describe_numerical_feature(load(spark, d, "lineitem"), "l_extendedprice"), 4, variance=0)


@query("describe_numerical_events", _describe_sql("value", "events"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.describe_numerical_feature(load(spark, d, "events"), "value"), 4, variance=0)


@query(
    "describe_categorical",
    "WITH n AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS c, count(*) AS n FROM orders GROUP BY 1), "
    "r AS (SELECT *, row_number() OVER (ORDER BY n DESC, c NULLS LAST) AS pos, sum(n) OVER () AS t FROM n), "
    "k AS (SELECT CASE WHEN pos > 3 THEN 'Other (' || (SELECT count(*) FROM r WHERE pos > 3) || ')' ELSE coalesce(c, 'Missing') END AS category, n, t FROM r) "
    "SELECT category, sum(n)::BIGINT AS n, round(100.0 * sum(n) / max(t), 2)::DOUBLE AS pct FROM k GROUP BY category",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")).alias("c"))
    return profile.describe_categorical_feature(o, "c", top_n=3)


for _freq, _part in (("YE", "year"), ("ME", "month"), ("W", "week"), ("D", "day"), ("H", "hour")):
    _table, _col = ("events", "ts") if _freq == "H" else ("lineitem", "l_shipdate")

    def _series(spark: SparkSession, d: str, freq: str = _freq, table: str = _table, col: str = _col) -> DataFrame:
        return profile.describe_time_series_feature(load(spark, d, table), col, freq)

    query(f"time_series_{_freq.lower()}", f"SELECT extract({_part} FROM {_col})::BIGINT::VARCHAR AS period, count(*) AS n FROM {_table} GROUP BY 1")(_series)


@query(
    "numerical_feature_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(min(l.{c}), 4) AS min, round(avg(l.{c}), 4) AS mean, round(max(m), 4) AS median, round(max(l.{c}), 4) AS max, round(stddev(l.{c}), 4) AS std, "
        f"round(skewness(l.{c}), 4) AS skewness, round(kurtosis(l.{c}), 4) AS kurtosis, count(*) FILTER (l.{c} < a - 1.5 * (b - a) OR l.{c} > b + 1.5 * (b - a)) AS n_outliers, "
        f"round(100.0 * count(*) FILTER (l.{c} < a - 1.5 * (b - a) OR l.{c} > b + 1.5 * (b - a)) / count(*), 4)::DOUBLE AS pct_outliers, "
        f"concat_ws('; ', CASE WHEN skewness(l.{c}) > 1 THEN 'HIGH RIGHT SKEW' END, CASE WHEN skewness(l.{c}) < -1 THEN 'HIGH LEFT SKEW' END, "
        f"CASE WHEN 100.0 * count(*) FILTER (l.{c} = 0) / count(*) > 5 THEN 'ZERO-INFLATED' END, CASE WHEN kurtosis(l.{c}) > 3 THEN 'HEAVY TAILS' END) AS flags "
        f"FROM lineitem l, (SELECT quantile_cont({c}, 0.25) AS a, median({c}) AS m, quantile_cont({c}, 0.75) AS b FROM lineitem)"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.numerical_feature_statistics(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


@query(
    "bin_regression_target",
    "WITH r AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), "
    "b AS (SELECT *, greatest(((r * 4 + n - 2) // (n - 1)) - 1, 0) AS band FROM r) "
    "SELECT o_orderkey, 'Q' || (band + 1) || ' [' || printf('%.3f', min(o_totalprice) OVER (PARTITION BY band)) || ', ' || printf('%.3f', max(o_totalprice) OVER (PARTITION BY band)) || ']' AS target_band FROM b",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.bin_regression_target(load(spark, d, "orders"), "o_totalprice", 4, "o_orderkey").select("o_orderkey", "target_band")


_BY = (
    "count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS mean, round(stddev(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1, "
    "round(median(l_extendedprice), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, round(max(l_extendedprice), 4) AS max, round(skewness(l_extendedprice), 4) AS skewness, "
    "round(100.0 * (count(*) - count(l_extendedprice)) / count(*), 4)::DOUBLE AS missing_pct FROM lineitem"
)


@query("describe_by_target", f"SELECT l_returnflag AS \"group\", {_BY} GROUP BY l_returnflag UNION ALL SELECT 'Overall', {_BY}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.describe_feature_by_target(load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag"), 4)


@query(
    "numerical_target_association",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round((SELECT sum(n * power(m - (SELECT avg({c}) FROM lineitem), 2)) FROM (SELECT count(*) AS n, avg({c}) AS m FROM lineitem GROUP BY l_returnflag)) "
        f"/ (SELECT var_pop({c}) * count(*) FROM lineitem), 8) AS eta_squared, round((12.0 / (n * (n + 1.0)) * h - 3 * (n + 1.0)) / (1 - ties / (power(n, 3) - n)), 4) AS h FROM "
        f"(SELECT sum(power(r, 2) / k) AS h, sum(k)::DOUBLE AS n FROM (SELECT sum(rk) AS r, count(*)::DOUBLE AS k FROM (SELECT l_returnflag, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk FROM lineitem) GROUP BY l_returnflag)), "
        f"(SELECT sum(power(t, 3) - t) AS ties FROM (SELECT count(*)::DOUBLE AS t FROM lineitem GROUP BY {c}))"
        for c in ("l_quantity", "l_tax")
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = profile.numerical_target_association(load(spark, d, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag")
    return found.select("feature", F.round("eta_squared", 8).alias("eta_squared"), F.round("h", 4).alias("h"))


@query("numerical_target_association_bands")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.numerical_target_association(load(spark, d, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", "regression", id_col="l_orderkey").drop("classes")


@query(
    "categorical_feature_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count({c}) AS n_unique, max(CASE WHEN pos = 1 THEN substr({c}, 1, 25) END) AS mode, round(max(CASE WHEN pos = 1 THEN 100.0 * n / t END), 6)::DOUBLE AS mode_pct, "
        f"round(sum(CASE WHEN pos <= 3 THEN 100.0 * n / t END), 6)::DOUBLE AS top3_pct, round(sum(-(n / k) * ln(n / k)) / ln(count({c})), 6) AS entropy, count(*) FILTER (100.0 * n / t < 5) AS n_rare, 0.0::DOUBLE AS missing_pct "
        f"FROM (SELECT {c}, n, sum(n) OVER () AS t, (sum(n) OVER ())::DOUBLE AS k, row_number() OVER (ORDER BY n DESC, {c}) AS pos FROM (SELECT {c}, count(*) AS n FROM part GROUP BY {c}))"
        for c in ("p_brand", "p_type")
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(profile.categorical_feature_statistics(load(spark, d, "part"), ["p_brand", "p_type"]))


@query(
    "describe_categorical_by_target",
    "WITH c AS (SELECT o_orderpriority AS category, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1 "
    "UNION ALL SELECT 'Total', count(*), count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P') FROM orders) "
    "SELECT category, n, round(100.0 * n / (SELECT count(*) FROM orders), 2)::DOUBLE AS pct, f AS \"F_n\", o AS \"O_n\", p AS \"P_n\", round(100.0 * f / n, 2)::DOUBLE AS \"F_pct\", round(100.0 * o / n, 2)::DOUBLE AS \"O_pct\", round(100.0 * p / n, 2)::DOUBLE AS \"P_pct\" FROM c",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.describe_categorical_by_target(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus")


_CELLS = "SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM {t} GROUP BY 1, 2"
_ASSOC = (
    "WITH n AS (" + _CELLS + "), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c, sum(n) OVER () AS t FROM n), "
    "k AS (SELECT count(DISTINCT a) AS ka, count(DISTINCT b) AS kb, max(t) * (sum(n * n / (r * c)) - 1) AS chi2, max(t) AS t, sum(-n / t * ln(n / r)) AS cond FROM m), "
    "e AS (SELECT sum(-c / t * ln(c / t)) AS h FROM (SELECT DISTINCT b, c, t FROM m)) "
)


@query(
    "categorical_target_association",
    _ASSOC.format(a="p_brand", b="p_type", t="part") + "SELECT 'p_brand' AS feature, ka AS n_unique, round(sqrt(chi2 / (t * (least(ka, kb) - 1))), 6) AS cramers_v, round((h - cond) / h, 6) AS theils_u, round(chi2, 4) AS chi2 FROM k, e",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = profile.categorical_target_association(load(spark, d, "part"), ["p_brand"], "p_type")
    return rounded(found.drop("p_value"), 6, chi2=4)


@query("categorical_target_association_p")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profile.categorical_target_association(load(spark, d, "lineitem"), ["l_linestatus"], "l_returnflag")


@query(
    "mutual_information_discrete",
    "WITH n AS (" + _CELLS.format(a="p_type", b="p_brand", t="part") + "), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS r, sum(n) OVER (PARTITION BY b) AS c, sum(n) OVER () AS t FROM n) "
    "SELECT 'p_type' AS feature, round(sum(n / t * ln(n * t / (r * c))), 6) AS score FROM m",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = profile.mutual_information_scores(load(spark, d, "part"), ["p_type"], "p_brand")
    return rounded(table_of(spark, list(found.items()), "feature string, score double"))


@query("mutual_information_continuous")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = profile.mutual_information_scores(load(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_returnflag"], "l_extendedprice", "regression")
    return table_of(spark, list(found.items()), "feature string, score double")


@query("categorical_columns", "SELECT 'l_linestatus' AS feature WHERE (SELECT count(DISTINCT l_linestatus) FROM lineitem) < 100 UNION ALL SELECT 'l_returnflag' WHERE (SELECT count(DISTINCT l_returnflag) FROM lineitem) < 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table_of(spark, [(c,) for c in profile.get_categorical_features(load(spark, d, "lineitem"))], "feature string")


@query(
    "unique_items",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT lower(trim(u)) AS x FROM unnest([o_orderpriority, ' ' || o_orderstatus || ' ', o_orderpriority]) AS t(u))) END AS items FROM orders",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.lit("Not Provided")).otherwise(F.format_string("['%s', ' %s ', '%s']", "o_orderpriority", "o_orderstatus", "o_orderpriority"))
    return o.select("o_orderkey", F.array_join(profile.extract_unique_items(text), ",").alias("items"))


# ---- drift ----


def _years(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = load(spark, d, "lineitem")
    year = F.year("l_shipdate")
    return rows.where(year == 1995), rows.where(year == 2001)


_TWO = "a AS (SELECT {c} AS v FROM lineitem WHERE year(l_shipdate) = 1995), b AS (SELECT {c} AS v FROM lineitem WHERE year(l_shipdate) = 2001)"


@query(
    "numerical_drift",
    " UNION ALL ".join(
        "SELECT * FROM (WITH " + _TWO.format(c=c) + ", n AS (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT v, 1 AS x, 0 AS y FROM a UNION ALL SELECT v, 0, 1 FROM b) GROUP BY v), "
        "f AS (SELECT v, sum(x) OVER w / (sum(x) OVER ())::DOUBLE AS p, sum(y) OVER w / (sum(y) OVER ())::DOUBLE AS q, lead(v) OVER (ORDER BY v) AS nx FROM n WINDOW w AS (ORDER BY v)) "
        f"SELECT '{c}' AS feature, round(max(abs(p - q)), 6) AS ks, round(sum(abs(p - q) * (nx - v)), 4) AS wasserstein, "
        "round(((SELECT avg(v) FROM b) - (SELECT avg(v) FROM a)) / sqrt(((SELECT var_pop(v) FROM a) + (SELECT var_pop(v) FROM b)) / 2), 6) AS smd, "
        "round((SELECT stddev_pop(v) FROM b) / (SELECT stddev_pop(v) FROM a), 6) AS std_ratio FROM f)"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    ),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    found = drift.numerical_drift_analysis(*_years(spark, d), ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(found.select("feature", "ks", "wasserstein", "smd", "std_ratio"), 6, wasserstein=4)


@query(
    "numerical_psi",
    "WITH " + _TWO.format(c="l_extendedprice") + ", e AS (SELECT quantile_cont(v, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM a), "
    "p AS (SELECT len(list_filter(q[2:10], lambda x: x <= v)) AS bin, count(*) / (SELECT count(*) FROM a)::DOUBLE AS s FROM a, e GROUP BY 1), "
    "r AS (SELECT len(list_filter(q[2:10], lambda x: x <= v)) AS bin, count(*) / (SELECT count(*) FROM b)::DOUBLE AS s FROM b, e GROUP BY 1), "
    "j AS (SELECT greatest(coalesce(p.s, 0), 1e-6) AS x, greatest(coalesce(r.s, 0), 1e-6) AS y FROM p FULL JOIN r USING (bin)) SELECT 'l_extendedprice' AS feature, round(sum((y - x) * ln(y / x)), 6) AS psi FROM j",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table_of(spark, [("l_extendedprice", drift.numerical_psi(*_years(spark, d), "l_extendedprice"))], "feature string, psi double"))


@query(
    "categorical_drift",
    "WITH a AS (SELECT event_type AS v FROM events WHERE user_id % 2 = 0), b AS (SELECT event_type AS v FROM events WHERE user_id % 2 = 1 AND event_type <> 'click'), "
    "x AS (SELECT v, count(*) / (SELECT count(*) FROM a)::DOUBLE AS p FROM a GROUP BY v), y AS (SELECT v, count(*) / (SELECT count(*) FROM b)::DOUBLE AS q FROM b GROUP BY v), "
    "j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM x FULL JOIN y USING (v)), l AS (SELECT *, (p + q) / 2 AS m, greatest(p, 1e-6) AS pp, greatest(q, 1e-6) AS qq FROM j) "
    "SELECT 'event_type' AS feature, round(sqrt(sum(((CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + (CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END)) / 2)), 6) AS js_distance, "
    "round(sum((qq - pp) * ln(qq / pp)), 6) AS psi, count(*) FILTER (p = 0) AS new_categories, count(*) FILTER (q = 0) AS missing_categories FROM l",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    found = drift.categorical_drift_analysis(e.where("user_id % 2 = 0"), e.where("user_id % 2 = 1 AND event_type <> 'click'"), ["event_type"])
    return rounded(found.select("feature", "js_distance", "psi", "new_categories", "missing_categories"))


@query("ks_test", "WITH n AS (SELECT v, sum(x) AS x, sum(y) AS y FROM (SELECT l_tax AS v, 1 AS x, 0 AS y FROM lineitem UNION ALL SELECT l_discount, 0, 1 FROM lineitem) GROUP BY v), f AS (SELECT sum(x) OVER w / (sum(x) OVER ())::DOUBLE AS p, sum(y) OVER w / (sum(y) OVER ())::DOUBLE AS q FROM n WINDOW w AS (ORDER BY v)) SELECT round(max(abs(p - q)), 6) AS ks FROM f")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table_of(spark, [(drift.ks_test(load(spark, d, "lineitem"), "l_tax", "l_discount")[0],)], "ks double"))


# ---- cleaning and imputation ----


@query("top_shares", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(max(n) / sum(n), 6)::DOUBLE AS share FROM (SELECT count(*) AS n FROM orders GROUP BY {c})" for c in ("o_orderstatus", "o_orderpriority")))
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(clean.top_shares(load(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"]))


@query("bijective_features", "SELECT 'n_name' AS removed WHERE (SELECT count(DISTINCT s_nationkey) FROM supplier) BETWEEN 2 AND (SELECT count(*) - 1 FROM supplier)")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = load(spark, d, "supplier").join(F.broadcast(load(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    return table_of(spark, [(c,) for c in clean.remove_bijective_features(j)[1]], "removed string")


@query("duplicate_columns", "SELECT 'again' AS removed")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderstatus").alias("again"), F.lower("o_orderstatus").alias("other"))
    return table_of(spark, [(c,) for c in clean.duplicate_columns(o, "o_orderkey")], "removed string")


@query(
    "initial_removal",
    "SELECT 'constant' AS reason, 'one' AS feature FROM orders HAVING count(DISTINCT 1) = 1 UNION ALL SELECT 'empty', 'none' FROM orders HAVING count(NULL) = 0 "
    "UNION ALL SELECT 'bijective', 'copy' FROM orders HAVING count(DISTINCT (o_orderpriority, lower(o_orderpriority))) = count(DISTINCT o_orderpriority)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lower("o_orderpriority").alias("copy"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    return table_of(spark, [(k, c) for k, cs in clean.initial_features_removal(o, "o_orderkey")[1].items() for c in cs], "reason string, feature string")


@query(
    "missing_groups",
    "WITH m AS (SELECT unnest(['a', 'b', 'c']) AS feature, unnest([avg((o_orderkey % 7 = 0)::INT), avg((o_orderkey % 20 = 0)::INT), 0.0]) AS share FROM orders) "
    "SELECT 'low_missing' AS kind, feature FROM m WHERE share > 0 AND share <= 0.1 UNION ALL SELECT 'high_missing', feature FROM m WHERE share > 0.1 "
    "UNION ALL SELECT 'any_missing', feature FROM m WHERE share > 0 UNION ALL SELECT 'no_missing', feature FROM m WHERE share = 0",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 20 != 0, F.col("o_orderpriority")).alias("b"), F.col("o_orderstatus").alias("c"))
    return table_of(spark, [(k, c) for k, cs in clean.categorize_categorical_features_by_missing(o, ["a", "b", "c"]).items() for c in cs], "kind string, feature string")


@query("encode_target", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::INT AS o_orderstatus FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return clean.encode_target_feature(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus")[0]


@query("joint_distribution_imputation", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN n_regionkey WHEN (count(*) FILTER (c_custkey % 7 <> 0) OVER (PARTITION BY c_nationkey)) >= 10 THEN n_regionkey END AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").join(F.broadcast(load(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 7 != 0, F.col("n_regionkey")).alias("n_regionkey"))
    return impute.impute_missing_values(c, ["n_regionkey"], ["c_nationkey"]).select("c_custkey", "n_regionkey")


@query(
    "association_imputation",
    "WITH l AS (SELECT *, CASE WHEN (l_orderkey + l_linenumber) % 6 = 0 THEN NULL ELSE l_returnflag END AS f FROM lineitem), "
    "m AS (SELECT l_linestatus, arg_max(f, (n, -ascii(f))) AS fill FROM (SELECT l_linestatus, f, count(*) AS n FROM l WHERE f IS NOT NULL GROUP BY 1, 2) GROUP BY 1) "
    "SELECT l_orderkey, l_linenumber, coalesce(f, fill) AS f FROM l JOIN m USING (l_linestatus)",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", F.when((F.col("l_orderkey") + F.col("l_linenumber")) % 6 != 0, F.col("l_returnflag")).alias("f"))
    return impute.StatisticalAssociationImputer(features=["l_linestatus", "f"], top_n=1).fit_transform(rows).select("l_orderkey", "l_linenumber", "f")


@query("cramers_v_corrected", _ASSOC.format(a="p_brand", b="p_type", t="part") + ", z AS (SELECT greatest(0, chi2 / t - (ka - 1) * (kb - 1) / (t - 1)) AS phi, least(ka - power(ka - 1, 2) / (t - 1), kb - power(kb - 1, 2) / (t - 1)) - 1 AS l FROM k) SELECT round(sqrt(phi / l), 6) AS v, (SELECT round((h - cond) / h, 6) FROM k, e) AS u FROM z")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "part")
    return rounded(table_of(spark, [(impute.cramers_v(p, "p_brand", "p_type"), impute.theils_u(p, "p_brand", "p_type"))], "v double, u double"))


# ---- conversion ----


@query("case_normalizer", "SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS c_mktsegment FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return convert.CaseNormalizer(["c_mktsegment"], "capitalize").fit_transform(load(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@query("categorical_cleaner", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS o_orderpriority FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return convert.CategoricalCleaner({"5-LOW": ["o_orderpriority"]}).fit_transform(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"))


@query("categorical_aligner", "WITH m AS (SELECT c_mktsegment AS fill FROM customer WHERE c_nationkey < 12 AND c_mktsegment <> 'BUILDING' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT c_custkey, CASE WHEN c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_nationkey < 12 AND c_mktsegment <> 'BUILDING') THEN c_mktsegment ELSE fill END AS c_mktsegment FROM customer, m")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return convert.CategoricalAligner(["c_mktsegment"]).fit(c.where("c_nationkey < 12 AND c_mktsegment <> 'BUILDING'")).transform(c).drop("c_nationkey")


@query("dtypes_converter", "SELECT o_orderkey::VARCHAR AS o_orderkey, o_totalprice::DOUBLE AS o_totalprice, o_orderstatus FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return convert.DtypesConverter({"o_orderkey": "string", "o_orderstatus": "int"}).fit_transform(load(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"))


@query("numerical_downcaster", "SELECT p_partkey::SMALLINT AS p_partkey, p_size::TINYINT AS p_size, p_retailprice::FLOAT AS p_retailprice FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return convert.optimize_memory(load(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"))


# ---- feature generators ----


@query("count_encoding", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority)::INT AS \"CE_o_orderpriority\", count(*) OVER (PARTITION BY o_custkey)::INT AS \"CE_o_custkey\" FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return encode.CountEncoder(["o_orderpriority", "o_custkey"]).fit_transform(load(spark, d, "orders")).select("o_orderkey", "CE_o_orderpriority", "CE_o_custkey")


@query("count_encoding_unseen", "SELECT event_id, CASE WHEN event_type = 'click' THEN 0 ELSE coalesce((SELECT count(*) FROM events e WHERE e.event_type = events.event_type), 0) END::INT AS \"CE_event_type\" FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").select("event_id", "event_type")
    return encode.CountEncoder(["event_type"]).fit(e.where("event_type <> 'click'")).transform(e).drop("event_type")


@query("cross_numeric", "SELECT l_orderkey, l_linenumber, round((l_discount * l_quantity)::FLOAT::DOUBLE, 4) AS \"l_discount_l_quantity\" FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    return rounded(encode.CrossFeatureGenerator(["l_quantity", "l_discount"]).fit_transform(rows).select("l_orderkey", "l_linenumber", "l_discount_l_quantity"), 4)


@query("cross_categorical", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_brand || '_' || p_type) - 1)::INT AS p_brand_p_type FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return encode.CrossFeatureGenerator(["p_type", "p_brand"]).fit_transform(load(spark, d, "part")).select("p_partkey", "p_brand_p_type")


@query("digits_encoding", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"(floor(abs(l_extendedprice) * {10.0**-k!r}::DOUBLE) % 10)::TINYINT AS l_extendedprice_d{k}" for k in range(0, 2)) + " FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem")
    return encode.DigitsEncodingFeatureGenerator(["l_extendedprice"], digit_limits=(2, 4)).fit_transform(rows).select("l_orderkey", "l_linenumber", "l_extendedprice_d0", "l_extendedprice_d1")


_Y = "(o_totalprice > 150000)::INT"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").withColumn("y", (F.col("o_totalprice") > 150000).cast("int"))


@query(
    "target_encoding_oof",
    f"WITH o AS (SELECT o_orderkey, o_orderpriority AS p, {_Y}::DOUBLE AS y, o_orderkey % 5 AS f FROM orders), w AS (SELECT *, sum(y) OVER (PARTITION BY p) - sum(y) OVER (PARTITION BY p, f) AS s, "
    "count(*) OVER (PARTITION BY p) - count(*) OVER (PARTITION BY p, f) AS n, avg(y) OVER () AS g FROM o) SELECT o_orderkey, round(((s + g * 10) / (n + 10))::FLOAT::DOUBLE, 5) AS \"TE_MEAN_o_orderpriority\" FROM w",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    te = encode.TargetEncodingFeatureGenerator(["o_orderpriority"], "y", id_col="o_orderkey")
    return rounded(te.fit_transform(_orders(spark, d), fold=F.pmod("o_orderkey", F.lit(5)).cast("int")).select("o_orderkey", "TE_MEAN_o_orderpriority"), 5)


for _agg, _fun in (("median", "(median(y) * count(*) + g * 10) / (count(*) + 10)"), ("nunique", "count(DISTINCT y) / count(*)::DOUBLE")):

    def _te(spark: SparkSession, d: str, agg: str = _agg) -> DataFrame:
        te = encode.TargetEncodingFeatureGenerator(["o_orderpriority"], "o_totalprice", agg, folds=0)
        return rounded(te.fit_transform(_orders(spark, d)).select("o_orderkey", f"TE_{agg.upper()}_o_orderpriority"), 0 if agg == "median" else 5)

    query(
        f"target_encoding_{_agg}",
        f"WITH g AS (SELECT median(o_totalprice) AS g FROM orders), s AS (SELECT o_orderpriority AS p, ({_fun.replace('g *', 'max(g) *')})::FLOAT::DOUBLE AS te FROM (SELECT *, o_totalprice AS y FROM orders), g GROUP BY 1) "
        f"SELECT o_orderkey, round(te, {0 if _agg == 'median' else 5}) AS \"TE_{_agg.upper()}_o_orderpriority\" FROM orders JOIN s ON o_orderpriority = p",
    )(_te)


@query("feature_pipeline", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority, o_orderstatus)::INT AS \"CE_o_orderpriority_o_orderstatus\" FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    steps = [encode.CrossFeatureGenerator(["o_orderpriority", "o_orderstatus"]), encode.CountEncoder(["__NEW__"])]
    return encode.FeatureGenerationPipeline(steps, final_features=["o_orderkey", "CE_o_orderpriority_o_orderstatus"]).fit_transform(load(spark, d, "orders"))


# ---- expansions ----


def _expansion(name: str, kind: str, make: Callable[[], expand.Expansion], column: str, sql: str, table: str = "lineitem", ids: str = "l_orderkey, l_linenumber", places: int = 6, rows: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    out = f"{column}_{getattr(expand, kind).suffix}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(make().fit_transform(rows(load(spark, d, table))).select(*ids.split(", "), out), places)

    query(name, f'WITH x AS ({sql}) SELECT {ids}, v AS "{out}" FROM x')(run)


_WITH = lambda n: getattr(expand, f"{n}WithOriginal")
_expansion("count_frequency", "CountFrequencyEncoder", lambda: _WITH("CountFrequencyEncoder")(["l_returnflag"], "frequency"), "l_returnflag", "SELECT *, round(count(*) OVER (PARTITION BY l_returnflag) / (count(*) OVER ())::DOUBLE, 6) AS v FROM lineitem")
_expansion(
    "mean_encoder", "MeanEncoder", lambda: _WITH("MeanEncoder")("y", ["o_orderpriority"], smoothing=5), "o_orderpriority",
    f"SELECT *, round((sum({_Y}) OVER (PARTITION BY o_orderpriority) + 5 * avg({_Y}) OVER ()) / (count(*) OVER (PARTITION BY o_orderpriority) + 5), 6) AS v FROM orders", "orders", "o_orderkey", rows=lambda df: df.withColumn("y", (F.col("o_totalprice") > 150000).cast("int")),
)
_expansion(
    "woe_encoder", "WoEEncoder", lambda: _WITH("WoEEncoder")("y", ["o_orderpriority"]), "o_orderpriority",
    f"SELECT *, round(ln((sum({_Y}) OVER (PARTITION BY o_orderpriority) / (sum({_Y}) OVER ())::DOUBLE) / (sum(1 - {_Y}) OVER (PARTITION BY o_orderpriority) / (sum(1 - {_Y}) OVER ())::DOUBLE)), 6) AS v FROM orders", "orders", "o_orderkey",
    rows=lambda df: df.withColumn("y", (F.col("o_totalprice") > 150000).cast("int")),
)
_expansion("rare_label", "RareLabelEncoder", lambda: _WITH("RareLabelEncoder")(["p_brand"], 0.04, 10), "p_brand", "SELECT *, CASE WHEN count(*) OVER (PARTITION BY p_brand) / (count(*) OVER ())::DOUBLE >= 0.04 THEN p_brand ELSE 'Rare' END AS v FROM part", "part", "p_partkey")
_expansion("arbitrary_discretiser", "ArbitraryDiscretiser", lambda: _WITH("ArbitraryDiscretiser")({"l_quantity": [0, 10, 25, 40]}), "l_quantity", "SELECT *, (CASE WHEN l_quantity < 0 OR l_quantity > 40 THEN NULL WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 ELSE 2 END)::INT AS v FROM lineitem")
_expansion("equal_frequency", "EqualFrequencyDiscretiser", lambda: _WITH("EqualFrequencyDiscretiser")(["l_extendedprice"], 5), "l_extendedprice", "SELECT l.*, len(list_filter(q, lambda e: e < l_extendedprice))::INT AS v FROM lineitem l, (SELECT quantile_cont(l_extendedprice, [.2, .4, .6, .8]) AS q FROM lineitem)")
_expansion("equal_width", "EqualWidthDiscretiser", lambda: _WITH("EqualWidthDiscretiser")(["l_extendedprice"], 10), "l_extendedprice", "SELECT l.*, len(list_filter(range(1, 10), lambda i: a + (b - a) * i / 10 < l_extendedprice))::INT AS v FROM lineitem l, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)")
_expansion("geometric_width", "GeometricWidthDiscretiser", lambda: _WITH("GeometricWidthDiscretiser")(["l_extendedprice"], 5), "l_extendedprice", "SELECT l.*, len(list_filter(range(1, 5), lambda i: round(a + power(power(b - a, 0.2), i), 7) < l_extendedprice))::INT AS v FROM lineitem l, (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)")
_IQR = "(SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem)"
_expansion("winsorize_iqr", "Winsorizer", lambda: _WITH("Winsorizer")(["l_extendedprice"], "iqr", "both", 0.5), "l_extendedprice", f"SELECT l.*, round(least(greatest(l_extendedprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 6) AS v FROM lineitem l, {_IQR}")
_expansion("winsorize_gaussian", "Winsorizer", lambda: _WITH("Winsorizer")(["l_extendedprice"], "gaussian", "right", 1.0), "l_extendedprice", "SELECT l.*, round(least(l_extendedprice, m + s), 4) AS v FROM lineitem l, (SELECT avg(l_extendedprice) AS m, stddev(l_extendedprice) AS s FROM lineitem)", places=4)
_expansion("winsorize_quantiles", "Winsorizer", lambda: _WITH("Winsorizer")(["l_extendedprice"], "quantiles", "both", 0.1), "l_extendedprice", "SELECT l.*, round(least(greatest(l_extendedprice, a), b), 6) AS v FROM lineitem l, (SELECT quantile_cont(l_extendedprice, 0.1) AS a, quantile_cont(l_extendedprice, 0.9) AS b FROM lineitem)")
_expansion("trim_iqr", "OutlierTrimmer", lambda: _WITH("OutlierTrimmer")(["l_extendedprice"], "iqr", "both", 0.4), "l_extendedprice", f"SELECT l.*, CASE WHEN l_extendedprice BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a) THEN l_extendedprice END AS v FROM lineitem l, {_IQR}")
_expansion("trim_mad", "OutlierTrimmer", lambda: _WITH("OutlierTrimmer")(["l_extendedprice"], "mad", "both", 1.0), "l_extendedprice", "SELECT l.*, CASE WHEN l_extendedprice BETWEEN m - 1.4826 * s AND m + 1.4826 * s THEN l_extendedprice END AS v FROM lineitem l, (SELECT median(l_extendedprice) AS m, mad(l_extendedprice) AS s FROM lineitem)")
_expansion("arcsin", "ArcsinTransformer", lambda: _WITH("ArcsinTransformer")(["l_discount"]), "l_discount", "SELECT *, round(asin(sqrt(l_discount)), 6) AS v FROM lineitem")
_expansion("log", "LogTransformer", lambda: _WITH("LogTransformer")(["l_extendedprice"]), "l_extendedprice", "SELECT *, round(ln(l_extendedprice), 6) AS v FROM lineitem")
_expansion("log10", "LogTransformer", lambda: _WITH("LogTransformer")(["l_extendedprice"], "10"), "l_extendedprice", "SELECT *, round(log10(l_extendedprice), 6) AS v FROM lineitem")
_expansion("log_cp", "LogCpTransformer", lambda: _WITH("LogCpTransformer")(["l_discount"], "e", 0.5), "l_discount", "SELECT *, round(ln(l_discount + 0.5), 6) AS v FROM lineitem")
_expansion("power", "PowerTransformer", lambda: _WITH("PowerTransformer")(["l_extendedprice"], 0.5), "l_extendedprice", "SELECT *, round(power(l_extendedprice, 0.5), 6) AS v FROM lineitem")
_expansion("reciprocal", "ReciprocalTransformer", lambda: _WITH("ReciprocalTransformer")(["l_quantity"]), "l_quantity", "SELECT *, round(1 / l_quantity, 6) AS v FROM lineitem")


@query("winsorizer_replace", f"SELECT l_orderkey, l_linenumber, round(least(greatest(l_extendedprice, a - 0.5 * (b - a)), b + 0.5 * (b - a)), 6) AS l_extendedprice FROM lineitem l, {_IQR}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(expand.Winsorizer(["l_extendedprice"], "iqr", "both", 0.5).fit_transform(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")))


@query("trimmer_replace", f"SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem l, {_IQR} WHERE l_extendedprice BETWEEN a - 0.4 * (b - a) AND b + 0.4 * (b - a)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return expand.OutlierTrimmer(["l_extendedprice"], "iqr", "both", 0.4).fit_transform(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"))


for _name, _columns in (("box_cox", ["l_extendedprice"]), ("yeo_johnson", ["l_extendedprice", "l_discount"])):
    _cls = {"box_cox": "BoxCoxTransformer", "yeo_johnson": "YeoJohnsonTransformer"}[_name]

    def _power(spark: SparkSession, d: str, cls: str = _cls, columns: list[str] = _columns) -> DataFrame:
        return getattr(expand, f"{cls}WithOriginal")(columns).fit_transform(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *columns))

    query(_name)(_power)


@query("string_similarity")
def _(spark: SparkSession, d: str) -> DataFrame:
    return expand.StringSimilarityEncoderWithOriginal(["p_type"]).fit_transform(load(spark, d, "part").select("p_partkey", "p_type"))


@query("decision_tree_encoder")
def _(spark: SparkSession, d: str) -> DataFrame:
    return expand.DecisionTreeEncoderWithOriginal("y", ["o_orderpriority"], depths=(2,)).fit_transform(_orders(spark, d).select("o_orderkey", "o_orderpriority", "y"))


@query("decision_tree_discretiser")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return expand.DecisionTreeDiscretiserWithOriginal("l_extendedprice", ["l_quantity"], "bin_number", depths=(2,)).fit_transform(rows)


# ---- sampling ----

_SIZES = "WITH c AS (SELECT o_orderstatus, count(*) AS k, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1), e AS (SELECT *, max(k) OVER () AS top, min(k) OVER () AS low FROM c) "


def _balance(name: str, strategy: str, sql: str) -> None:
    """Per class: its rows, how many are rows of the table, distinct ids, the fewest and the most copies of a table's
    row, and whether all totals lie in the range of the class."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
        out = sample.FoldwiseSampler("o_orderstatus", "o_orderkey", strategy).fit_transform(o)
        each = out.groupBy("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").agg(F.count("*").alias("n"))
        ends = o.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
        met = each.join(o.withColumn("own", F.lit(1)), o.columns, "left").join(ends, "o_orderstatus")
        own = F.col("own").isNotNull()
        return met.groupBy("o_orderstatus").agg(
            F.sum("n").alias("n"), F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n_own"), F.count_distinct("o_orderkey").alias("n_ids"),
            F.min(F.when(own, F.col("n"))).alias("fewest"), F.max(F.when(own, F.col("n"))).alias("most"), F.bool_and(F.col("o_totalprice").between(F.col("lo"), F.col("hi"))).alias("inside"),
        )

    query(name, _SIZES + sql)(run)


_balance("random_under", "random_under", "SELECT o_orderstatus, low AS n, low AS n_own, low AS n_ids, 1 AS fewest, 1 AS most, true AS inside FROM e")
_balance("random_over", "random_over", "SELECT o_orderstatus, top AS n, top AS n_own, k AS n_ids, (top // k)::BIGINT AS fewest, ((top + k - 1) // k)::BIGINT AS most, true AS inside FROM e")
_balance("sampler_none", "none", "SELECT o_orderstatus, k AS n, k AS n_own, k AS n_ids, 1 AS fewest, 1 AS most, true AS inside FROM e")
_balance("smote", "smote", "SELECT o_orderstatus, top AS n, k AS n_own, top AS n_ids, 1 AS fewest, 1 AS most, true AS inside FROM e")

# ---- metrics and reports ----

_LABELS = "SELECT l.doc_id, quality AS y, toxic AS pred, least(n_chars / 4000.0, 0.999)::DOUBLE AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


def _labels(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "n_chars")
    p = F.least(F.col("n_chars") / F.lit(4000.0), F.lit(0.999))
    return load(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.col("toxic").alias("pred"), p.alias("p"), F.array(1 - p, p).alias("prob"))


@query(
    "per_class_metrics",
    f"WITH x AS ({_LABELS}) SELECT c::VARCHAR AS cls, count(*) FILTER (y = c AND pred = c) AS tp, count(*) FILTER (y <> c AND pred = c) AS fp, count(*) FILTER (y = c AND pred <> c) AS fn, "
    "round(coalesce(count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (pred = c), 0), 0), 6)::DOUBLE AS precision, round(coalesce(count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (y = c), 0), 0), 6)::DOUBLE AS recall, "
    "round(coalesce(2 * count(*) FILTER (y = c AND pred = c) / nullif(count(*) FILTER (y = c) + count(*) FILTER (pred = c), 0), 0), 6)::DOUBLE AS f1, count(*) FILTER (y = c) AS support FROM x, (VALUES (0), (1)) AS k(c) GROUP BY c",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.per_class(_labels(spark, d), "y", "pred"))


@query("classification_summary", f"WITH x AS ({_LABELS}) SELECT round(avg((y = pred)::INT), 6) AS accuracy, round((avg(CASE WHEN y = 0 THEN (pred = 0)::INT END) + avg(CASE WHEN y = 1 THEN (pred = 1)::INT END)) / 2, 6) AS balanced_accuracy FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.classification_summary(_labels(spark, d), "y", "pred").select("accuracy", "balanced_accuracy"))


@query(
    "probability_metrics",
    f"WITH x AS ({_LABELS}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM x) "
    "SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) AS auc, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss, round(avg(power(p - y, 2)), 6) AS brier FROM r",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d).persist()
    out = (metrics.roc_auc(x, "y", "prob"), metrics.log_loss(x, "y", "prob"), metrics.brier_score(x, "y", "prob"))
    x.unpersist()
    return rounded(table_of(spark, [out], "auc double, log_loss double, brier double"))


@query("calibration_error", f"WITH x AS ({_LABELS}), b AS (SELECT len(list_filter(range(1, 10), lambda i: p >= i / 10)) AS bin, count(*) AS n, avg(p) AS c, avg(y) AS s FROM x GROUP BY 1) SELECT round(sum(n * abs(c - s)) / sum(n), 6) AS ece FROM b")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table_of(spark, [(metrics.expected_calibration_error(_labels(spark, d), "y", "p"),)], "ece double"))


@query("cutoff_predictions", f"WITH x AS ({_LABELS}) SELECT doc_id, (p >= 0.3)::INT AS binary_cut, (CASE WHEN (1 - p) / 0.7 >= p / 0.4 THEN 0 ELSE 1 END)::INT AS scaled_cut FROM x")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d).select("doc_id", metrics.apply_cutoffs(F.col("prob"), 0.3).alias("binary_cut"), metrics.apply_cutoffs(F.col("prob"), [0.7, 0.4]).alias("scaled_cut"))


@query("f_beta_selection", f"WITH x AS ({_LABELS}), z AS (SELECT avg(CASE WHEN p >= 0.5 THEN pred + y END) / 2.0 AS w, avg((p >= 0.5)::INT) AS c FROM x) SELECT round(1.01 * least(w, 1) * c / (0.01 * least(w, 1) + c), 6) AS score FROM z")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d).withColumn("points", F.col("pred") + F.col("y"))
    return rounded(table_of(spark, [(metrics.f_beta_selection_score(x, "y", "p", "points", metrics.FBetaSelectionConfig(normalize_by=2.0)),)], "score double"))


_REG = (
    "round(avg(abs(y - p)), 4) AS mae, round(median(abs(y - p)), 4) AS medae, round(avg(power(y - p, 2)), 2) AS mse, round(sqrt(avg(power(y - p, 2))), 4) AS rmse, round(avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END), 6) AS mape, "
    "round(1 - sum(power(y - p, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(1 - var_pop(y - p) / var_pop(y), 6) AS explained_variance"
)


@query(
    "regression_results",
    f"WITH x AS (SELECT o_totalprice AS y, o_totalprice * 0.9 + 10 * (o_orderkey % 7) AS p, o_orderkey % 4 = 0 AS t FROM orders) SELECT 'Train' AS split, {_REG} FROM x WHERE NOT t UNION ALL SELECT 'Test', {_REG} FROM x WHERE t",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + 10 * (F.col("o_orderkey") % 7)).alias("p"), (F.col("o_orderkey") % 4 == 0).alias("t"))
    return rounded(report.regression_results(o.where("NOT t"), o.where("t"), "y", "p"), 4, mse=2, mape=6, r2=6, explained_variance=6)


@query("classification_report", f"WITH x AS ({_LABELS}) SELECT CASE WHEN doc_id % 3 = 0 THEN 'Test' ELSE 'Train' END AS split, 'none' AS cut, round(avg((y = pred)::INT), 6) AS accuracy FROM x GROUP BY 1 UNION ALL SELECT CASE WHEN doc_id % 3 = 0 THEN 'Test' ELSE 'Train' END, 'cutoffs', round(avg((y = (p >= 0.4)::INT)::INT), 6) FROM x GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    name = {0: "low", 1: "high"}
    x = _labels(spark, d)
    x = x.withColumns({"y": convert.label_of(F.col("y"), name), "pred": convert.label_of(F.col("pred"), name)})
    overall, _each = report.classification_results(x.where("doc_id % 3 <> 0"), x.where("doc_id % 3 = 0"), "y", "pred", "prob", name, 0.4)
    return rounded(overall.select("split", "cut", "accuracy"))


@query("top_regression_errors", "SELECT o_orderkey, round(o_totalprice * 0.1 - o_orderkey % 7, 4) AS error FROM orders WHERE o_totalprice * 0.1 - o_orderkey % 7 > 0 ORDER BY o_totalprice * 0.1 - o_orderkey % 7 DESC LIMIT 15")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 0.9 + (F.col("o_orderkey") % 7)).alias("p"))
    return rounded(report.get_top_regression_under_over_errors(o, "o_totalprice", "p")[0].select("o_orderkey", "error"), 4)


@query("top_classification_errors", f"WITH x AS ({_LABELS}) SELECT doc_id, round(1 - 2 * p, 6) AS gap FROM x WHERE y = 1 AND p < 0.5 ORDER BY p, doc_id LIMIT 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.get_top_classification_errors(_labels(spark, d).orderBy("doc_id"), "y", "prob", 1, top_n=5).select("doc_id", "gap"))


@query("cutoff_sweep", f"WITH x AS ({_LABELS}), c AS (SELECT DISTINCT p AS cutoff FROM x) SELECT round(cutoff, 6) AS cutoff, count(*) FILTER (p >= cutoff AND y = 1) AS tp, count(*) FILTER (p >= cutoff AND y = 0) AS fp, count(*) FILTER (p < cutoff AND y = 1) AS fn, count(*) FILTER (p < cutoff AND y = 0) AS tn FROM x, c GROUP BY cutoff")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tune.binary_cutoff_table(_labels(spark, d), "y", F.col("p")))


@query(
    "pseudo_labels",
    f"WITH x AS ({_LABELS}), u AS (SELECT doc_id, (p > 0.5)::INT AS k, greatest(p, 1 - p) AS c FROM x), t AS (SELECT k, quantile_cont(c, 0.8) AS t FROM u GROUP BY k) SELECT doc_id, u.k AS pseudo_label, round(c, 6) AS confidence FROM u JOIN t ON u.k = t.k WHERE c >= t",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    u = _labels(spark, d).select("doc_id", F.col("prob").alias("probability"))
    return rounded(tune.select_pseudo_labels(u, tune.top_k_thresholds(u, 0.2)).select("doc_id", "pseudo_label", "confidence"))


# ---- models: results that no SQL has ----


def _frame(spark: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    """All of lineitem. No column of it is a key, so the id is a hash of the whole row."""
    rows = load(spark, d, "lineitem")
    rows = rows.select(F.xxhash64(*rows.columns).alias("id"), *[number(rows, c).alias(c) for c in ("l_quantity", "l_discount", "l_tax")], "l_linestatus", (F.col("l_extendedprice") > 50000).cast("int").alias("y"), "l_extendedprice")
    return rows, ["l_quantity", "l_discount", "l_tax", "l_linestatus"]


def _cv(features: list[str], metric: str = "Roc AUC", problem: str = "classification", target: str = "y") -> train.CrossValidationTrainer:
    return train.CrossValidationTrainer(problem, metric, target, features, "id", 3)


_LR = lambda: LogisticRegression(maxIter=10)
_RF = lambda: RandomForestClassifier(numTrees=5, maxDepth=4, seed=17)


@query("cross_validation")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    a, b, _t = _cv(features).fit(_LR(), rows)
    return table_of(spark, [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "fold int, train double, valid double")


@query("cross_validation_regression")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    cv = _cv(features, "RMSE", "regression", "l_extendedprice")
    cv.fit(GBTRegressor(maxIter=5, maxDepth=3, seed=17), rows)
    return cv.predict_with_confidence(rows).select("id", "prediction", "std", "lower", "upper")


@query("oof_model")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return train.OOFModel(_RF(), _cv(features), True, "isotonic").fit(rows).predict(rows).select("id", "prediction", F.col("probability")[1].alias("p"))


@query("ensemble_model")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return train.EnsembleModel([_LR(), _RF()], "classification", "y", features, [2, 1]).fit(rows).predict(rows).select("id", "prediction", F.col("probability")[1].alias("p"))


@query("calibrated_model")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return train.CalibratedModel(_RF(), "y", features, "id", "sigmoid").fit(rows).predict(rows).select("id", "prediction", F.col("probability")[1].alias("p"))


@query("calibration_choice")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return tune.ClassificationCalibrator(_RF(), _cv(features)).fit(rows).summary(spark)


@query("cutoff_tuning")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return table_of(spark, [tune.CutoffTunerCV(_LR(), _cv(features, "F1")).tune(rows)], "cutoff double, score double")


@query("ensemble_weights")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return table_of(spark, [tune.EnsembleWeightTunerCV([_LR(), _RF()], _cv(features, "Log Loss"), 10).tune(rows)], "weights array<double>, score double")


@query("random_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    best, score = tune.RandomSearchCV(_cv(features), 2).tune(_LR(), rows, {"regParam": ("float", [1e-4, 1.0, "log"]), "maxIter": ("constant", [10])})
    return table_of(spark, [(str(best), score)], "params string, score double")


@query("pseudo_label_model")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    known, unknown = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0").drop("y")
    return tune.PseudoLabelGenerator(_cv(features)).fit(_LR(), known, unknown).stats()


@query("shap_values")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    model = train.BaseTrainer("classification", "y", features).fit_estimator(_RF(), rows)
    return shap.compute_shap_values(model, rows, features).select("id", "shap")


@query("mutual_information_filtering")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, features = _frame(spark, d)
    return table_of(spark, list(select.MutualInformationFiltering("y", keep_top_k=2, features=features).fit(rows).scores_.items()), "feature string, score double")


def _elimination(name: str, make: Callable[[list[str]], select._Elimination]) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows, features = _frame(spark, d)
        found = make(features)
        found.run(rows, features)
        return found.history(spark)

    query(name)(run)


_elimination("mutual_information_rfe", lambda f: select.MutualInformationRecursiveFeatureElimination(_LR(), _cv(f), 2))
_elimination("model_importance_rfe", lambda f: select.ModelImportanceRecursiveFeatureElimination(_RF(), _cv(f), 2))
_elimination("model_importance_filtering", lambda f: select.ModelImportanceFiltering(_RF(), _cv(f), 0.01))
_elimination("permutation_rfe", lambda f: select.PermutationRecursiveFeatureElimination(_LR(), _cv(f), 2, 1))
_elimination("shap_rfe", lambda f: select.ShapRecursiveFeatureElimination(_RF(), _cv(f), 2))



# ---- results of fitted operators that SQL can tell ----


@query("literal_table", "SELECT * FROM (VALUES (1, 'a', 0.5::DOUBLE), (2, NULL, 1.5::DOUBLE)) AS t(id, name, x)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table_of(spark, [(1, "a", 0.5), (2, None, 1.5)], "id int, name string, x double")


@query(
    "fill_values",
    "SELECT 'o_orderpriority' AS feature, (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS fill UNION ALL SELECT 'o_orderstatus', 'X'",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    fills = convert.CategoricalAligner.create_fill_values(load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], {"o_orderstatus": "X"}, "mode")
    return table_of(spark, list(fills.items()), "feature string, fill string")


@query(
    "text_columns",
    " UNION ALL ".join(f"SELECT '{c}' AS feature FROM {t} HAVING count(DISTINCT {c}) < 100" for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"))),
)
def _(spark: SparkSession, d: str) -> DataFrame:
    names = profile.get_categorical_features(load(spark, d, "customer"), any_binary=False)
    return table_of(spark, [(n,) for n in names], "feature string")


@query(
    "target_encoding_stats",
    "WITH g AS (SELECT avg(o_totalprice) AS g FROM orders) SELECT o_orderpriority AS feature, 'mean' AS aggregation, count(*) AS count, round((sum(o_totalprice) + 10 * any_value(g)) / (count(*) + 10), 0) AS te_value FROM orders, g GROUP BY 1",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    fitted = encode.TargetEncodingFeatureGenerator(["o_orderpriority"], "o_totalprice", id_col="o_orderkey").fit(o)
    return rounded(fitted.get_feature_stats("o_orderpriority"), 0)


def _powers(name: str, cls: str, table: str, column: str, form: str, slope: str) -> None:
    """The power of greatest likelihood, to two places, and the transformed values' mean and deviation there."""
    sql = (
        f"WITH g AS (SELECT i / 100.0 AS p FROM range(-300, 301) AS t(i)), s AS (SELECT p, var_pop({form}) AS v, sum({slope}) AS l, count(*) AS n FROM (SELECT {column} AS x FROM {table}), g GROUP BY p) "
        "SELECT round(arg_max(p, -n / 2 * ln(nullif(v, 0)) + (p - 1) * l), 2)::DOUBLE AS power FROM s"
    )

    def run(spark: SparkSession, d: str) -> DataFrame:
        fitted = getattr(expand, cls)([column]).fit(load(spark, d, table).select(column))
        return table_of(spark, [(round(fitted.lambdas_[column], 2) + 0.0,)], "power double")

    query(name, sql)(run)


_powers("box_cox_power", "BoxCoxTransformer", "orders", "o_totalprice", "CASE WHEN p = 0 THEN ln(x) ELSE (power(x, p) - 1) / p END", "ln(x)")
_powers(
    "yeo_johnson_power", "YeoJohnsonTransformer", "customer", "c_acctbal",
    "CASE WHEN x >= 0 AND p = 0 THEN ln(x + 1) WHEN x >= 0 THEN (power(x + 1, p) - 1) / p WHEN p = 2 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - p) - 1) / (2 - p) END", "sign(x) * ln(abs(x) + 1)",
)

#: The best single cut of rows (k: group, y) with groups in the order of column o; side is 0 up to the cut, 1 after it.
_STUMP = (
    "g AS (SELECT k, {o} AS o, sum(y) AS s, count(*) AS n FROM x GROUP BY k), r AS (SELECT *, sum(s) OVER w AS cs, sum(n) OVER w AS cn, sum(s) OVER () AS ts, sum(n) OVER () AS tn, row_number() OVER w AS i FROM g WINDOW w AS (ORDER BY o, k)), "
    "b AS (SELECT i AS cut FROM r WHERE cn < tn ORDER BY cs * cs / cn + (ts - cs) * (ts - cs) / (tn - cn) DESC, i LIMIT 1), side AS (SELECT k, (i > cut)::INT AS side, sum(s) OVER p / sum(n) OVER p AS leaf, ts / tn AS mean FROM r, b WINDOW p AS (PARTITION BY i > cut))"
)


@query("tree_encoder_stump", f"WITH x AS (SELECT o_orderkey, o_orderpriority AS k, o_totalprice AS y FROM orders), {_STUMP.format(o='avg(y)')} SELECT o_orderkey, round(leaf, 2) AS guess FROM x JOIN side USING (k)")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    out = expand.DecisionTreeEncoder("o_totalprice", ["o_orderpriority"], depths=(1,)).fit_transform(o)
    return rounded(out.select("o_orderkey", F.col("o_orderpriority").alias("guess")), 2)


_LINES = "SELECT l_discount AS k, l_extendedprice * (1 + l_discount) AS y FROM lineitem"


@query("tree_discretiser_stump", f"WITH x AS ({_LINES}), {_STUMP.format(o='k')} SELECT k AS l_discount, side AS bin, count(*) AS n FROM x JOIN side USING (k) GROUP BY ALL")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_discount", F.col("l_discount").alias("x"), (F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("y"))
    out = expand.DecisionTreeDiscretiser("y", ["x"], "bin_number", depths=(1,)).fit_transform(rows)
    return out.groupBy("l_discount", F.col("x").cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("shap_stump", f"WITH x AS ({_LINES}), {_STUMP.format(o='k')} SELECT k AS l_discount, round(leaf - mean, 2) AS shap, round(mean, 2) AS base FROM side")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_discount", (F.col("l_extendedprice") * (1 + F.col("l_discount"))).alias("y"))
    model = train.BaseTrainer("regression", "y", ["l_discount"]).fit_estimator(DecisionTreeRegressor(maxDepth=1), rows)
    out = shap.compute_shap_values(model, rows.select("l_discount").distinct(), ["l_discount"])
    return rounded(out.select("l_discount", F.col("shap")[0].alias("shap"), F.col("shap_base")[0].alias("base")), 2)


#: Straight lines fitted on the rows outside each of three folds.
_LINEAR = (
    "x AS (SELECT o_orderkey AS id, o_custkey::DOUBLE AS x, o_totalprice AS y, (o_orderkey % 3)::INT AS f FROM orders), "
    "m AS (SELECT k, regr_slope(y, x) AS a, regr_intercept(y, x) AS c, sum(x * y) / sum(x * x) AS z FROM x, (VALUES (0), (1), (2)) AS t(k) WHERE f <> k GROUP BY k)"
)


def _linear(spark: SparkSession, d: str) -> tuple[DataFrame, train.CrossValidationTrainer]:
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("x"), F.col("o_totalprice").alias("y"))
    return rows, train.CrossValidationTrainer("regression", "RMSE", "y", ["x"], "id", 3, fold=(F.col("id") % 3).cast("int"))


_OLS = lambda intercept=True: LinearRegression(solver="normal", fitIntercept=intercept)


@query(
    "cross_validation_scores",
    f"WITH {_LINEAR} SELECT k AS fold, round(sqrt(avg(CASE WHEN f <> k THEN power(y - a * x - c, 2) END)), 2) AS train, round(sqrt(avg(CASE WHEN f = k THEN power(y - a * x - c, 2) END)), 2) AS valid FROM x, m GROUP BY k",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, cv = _linear(spark, d)
    a, b, _t = cv.fit(_OLS(), rows)
    return rounded(table_of(spark, [(i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "fold int, train double, valid double"), 2)


@query("out_of_fold_predictions", f"WITH {_LINEAR} SELECT id, round(a * x + c, 0) AS prediction FROM x JOIN m ON f = k")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, cv = _linear(spark, d)
    cv.fit(_OLS(), rows)
    return rounded(cv.oof_.select("id", "prediction"), 0)


@query(
    "fold_models_with_confidence",
    f"WITH {_LINEAR} SELECT id, round(avg(a * x + c), 0) AS prediction, round(stddev_pop(a * x + c), 0) AS std, round(avg(a * x + c) - 1.96 * stddev_pop(a * x + c), 0) AS lower FROM x, m GROUP BY id",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, cv = _linear(spark, d)
    model = train.OOFModel(_OLS(), cv).fit(rows)
    means = model.predict(rows).select("id", F.col("prediction").alias("mean"))
    out = cv.predict_with_confidence(rows).join(means, "id")
    return rounded(out.select("id", F.col("mean").alias("prediction"), "std", "lower"), 0)


@query("ensemble_of_lines", "WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS a, regr_intercept(o_totalprice, o_custkey) AS c, sum(o_totalprice * o_custkey) / sum(o_custkey::DOUBLE * o_custkey) AS z FROM orders) SELECT o_orderkey AS id, round((2 * (a * o_custkey + c) + z * o_custkey) / 3, 0) AS prediction FROM orders, m")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, _cv_ = _linear(spark, d)
    return rounded(train.EnsembleModel([_OLS(), _OLS(False)], "regression", "y", ["x"], [2, 1]).fit(rows).predict(rows).select("id", "prediction"), 0)


@query(
    "search_of_lines",
    f"WITH {_LINEAR}, e AS (SELECT k, sqrt(avg(power(y - a * x - c, 2))) AS with_c, sqrt(avg(power(y - z * x, 2))) AS without FROM x JOIN m ON f = k GROUP BY k) SELECT avg(with_c) < avg(without) AS intercept, round(least(avg(with_c), avg(without)), 2) AS score FROM e",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, cv = _linear(spark, d)
    best, score = tune.RandomSearchCV(cv, 6, max_samples=1 << 62).tune(LinearRegression(solver="normal"), rows, {"fitIntercept": ("categorical", [True, False])})
    return rounded(table_of(spark, [(best["fitIntercept"], score)], "intercept boolean, score double"), 2)


@query(
    "mutual_information_filter",
    "WITH x AS (SELECT o_orderstatus AS y, o_orderpriority AS a, (o_orderkey % 4)::VARCHAR AS b, CASE WHEN o_orderstatus = 'F' THEN 'f' ELSE (o_orderkey % 2)::VARCHAR END AS c FROM orders), l AS (UNPIVOT x ON a, b, c INTO NAME f VALUE v), "
    "n AS (SELECT f, v, y, count(*) AS n FROM l GROUP BY ALL), p AS (SELECT f, n / sum(n) OVER (PARTITION BY f) AS p, sum(n) OVER (PARTITION BY f, v) / sum(n) OVER (PARTITION BY f) AS pv, sum(n) OVER (PARTITION BY f, y) / sum(n) OVER (PARTITION BY f) AS py FROM n), "
    "s AS (SELECT f AS feature, sum(p * ln(p / (pv * py))) AS score FROM p GROUP BY f) SELECT feature, round(score, 6) AS score, rank() OVER (ORDER BY score DESC) = 1 AS selected FROM s",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders")
    c = F.when(F.col("o_orderstatus") == "F", "f").otherwise((F.col("o_orderkey") % 2).cast("string"))
    rows = o.select(F.col("o_orderstatus").alias("y"), F.col("o_orderpriority").alias("a"), (F.col("o_orderkey") % 4).cast("string").alias("b"), c.alias("c"))
    found = select.MutualInformationFiltering("y", keep_top_k=1, features=["a", "b", "c"]).fit(rows)
    return rounded(table_of(spark, [(f, x, f in found.selected_) for f, x in found.scores_.items()], "feature string, score double, selected boolean"))


@query("removal_schedule", "SELECT i AS step, round(100 * (1 - 0.2 * i) / 3)::INT AS n FROM range(0, 5) AS t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table_of(spark, list(enumerate(select.compute_removal_schedule(100, 5))), "step long, n int")


@query("calibration_curve", f"WITH x AS ({_LABELS}) SELECT len(list_filter(range(1, 10), lambda i: p >= i / 10))::INT AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS share FROM x GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ece_bins(_labels(spark, d), "y", "p").select("bin", "n", "confidence", "share"))


@query(
    "auto_thresholds",
    f"WITH x AS ({_LABELS}), l AS (SELECT doc_id, y, k, CASE WHEN k = 1 THEN p ELSE 1 - p END AS q, greatest(p, 1 - p) AS top, (p > 0.5)::INT AS pred FROM x, (VALUES (0), (1)) AS t(k)) "
    "SELECT k::INT AS cls, round(least(CASE WHEN count(*) FILTER (doc_id % 2 = 0 AND y = k) >= 10 THEN quantile_cont(q, 0.8) FILTER (doc_id % 2 = 0 AND y = k) ELSE quantile_cont(q, 0.8) FILTER (doc_id % 2 = 0) END, quantile_cont(top, 0.8) FILTER (doc_id % 2 = 1 AND pred = k), 0.999999), 6) AS threshold FROM l GROUP BY k",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    x = _labels(spark, d).select("doc_id", "y", F.col("prob").alias("probability"))
    return rounded(tune.auto_thresholds(x.where("doc_id % 2 = 0"), "y", x.where("doc_id % 2 = 1"), 80.0))


#: Three classes, a prediction that is wrong for every fifth row, and scores of each class.
_THREE = (
    "x AS (SELECT o_orderkey, (o_orderkey % 3)::INT AS y, (CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey + 1) % 3 ELSE o_orderkey % 3 END)::INT AS pred, "
    "[1.0 + o_orderkey % 7, 1.0 + o_orderkey % 5, 1.0 + o_custkey % 4] AS w FROM orders), "
    "z AS (SELECT y, pred, k, w[k + 1] / list_sum(w) AS p FROM x, (VALUES (0), (1), (2)) AS t(k)), "
    "c AS (SELECT k, count(*) FILTER (y = k AND pred = k) AS tp, count(*) FILTER (y <> k AND pred = k) AS fp, count(*) FILTER (y = k AND pred <> k) AS fn FROM z GROUP BY k), "
    "r AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY p) + (count(*) OVER (PARTITION BY k, p) - 1) / 2.0 AS rk FROM z), "
    "a AS (SELECT k, (sum(CASE WHEN y = k THEN rk END) - sum((y = k)::INT) * (sum((y = k)::INT) + 1) / 2.0) / (sum((y = k)::INT) * sum((y <> k)::INT)) AS auc FROM r GROUP BY k)"
)
_CLASS_VALUES = {
    "F1 (Micro)": ("sum(tp) / sum(tp + fn)", "c"), "F1 (Macro)": ("avg(2.0 * tp / (2 * tp + fp + fn))", "c"), "F1 (Weighted)": ("sum(2.0 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn)", "c"),
    "Recall (Micro)": ("sum(tp) / sum(tp + fn)", "c"), "Recall (Macro)": ("avg(tp / (tp + fn))", "c"), "Recall (Weighted)": ("sum(tp / (tp + fn) * (tp + fn)) / sum(tp + fn)", "c"),
    "Precision (Micro)": ("sum(tp) / sum(tp + fp)", "c"), "Precision (Macro)": ("avg(tp / (tp + fp))", "c"), "Precision (Weighted)": ("sum(tp / (tp + fp) * (tp + fn)) / sum(tp + fn)", "c"),
    "Balanced Accuracy": ("avg(tp / (tp + fn))", "c"), "Roc AUC (Multi-class)": ("avg(auc)", "a"), "Log Loss": ("avg(-ln(p)) FILTER (y = k)", "z"), "Brier Score": ("avg(power(p - (y = k)::INT, 2))", "z"),
    "Share of misses": ("sum(fn) / sum(tp + fn)", "c"),
}


@query("multiclass_metrics", f"WITH {_THREE} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round({e}, 6)::DOUBLE AS value FROM {t}" for n, (e, t) in _CLASS_VALUES.items()))
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    w = [1.0 + k % 7, 1.0 + k % 5, 1.0 + F.col("o_custkey") % 4]
    x = load(spark, d, "orders").select((k % 3).cast("int").alias("y"), F.when(k % 5 == 0, (k + 1) % 3).otherwise(k % 3).cast("int").alias("pred"), F.array(*[v / (w[0] + w[1] + w[2]) for v in w]).alias("prob")).persist()
    own = {"name": "Share of misses", "function": lambda df, y, p, scale: df.agg(F.avg((F.col(y) != F.col(p)).cast("double")) * scale).first()[0], "metric_type": "preds", "direction": "minimize", "kwargs": {"scale": 1.0}}
    rows = []
    for name in _CLASS_VALUES:
        _n, metric, kind, _d = metrics.CustomMetricsHandler.extract_metric_details(own if name == own["name"] else None, name)
        rows.append((name, float(metric(x, "y", "prob" if kind == "probs" else "pred"))))
    x.unpersist()
    return rounded(table_of(spark, rows, "metric string, value double"))


_NUMBER_VALUES = {
    "MAE": ("avg(abs(y - p))", 2), "MAPE": ("avg(abs(y - p) / abs(y))", 6), "MSE": ("avg(power(y - p, 2))", 0), "RMSE": ("sqrt(avg(power(y - p, 2)))", 2), "R2": ("1 - sum(power(y - p, 2)) / (var_pop(y) * count(*))", 6),
    "RMSLE": ("sqrt(avg(power(ln(1 + y) - ln(1 + p), 2)))", 6), "RMSPE": ("sqrt(avg(power((y - p) / y, 2)))", 6),
}


@query("regression_metrics", "WITH x AS (SELECT o_totalprice AS y, o_totalprice * 0.9 + 10 * (o_orderkey % 7) AS p FROM orders) " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round({e}, {k})::DOUBLE AS value FROM x" for n, (e, k) in _NUMBER_VALUES.items()))
def _(spark: SparkSession, d: str) -> DataFrame:
    x = load(spark, d, "orders").select(F.col("o_totalprice").alias("y"), (F.col("o_totalprice") * 0.9 + 10 * (F.col("o_orderkey") % 7)).alias("p"))
    each = [table_of(spark, [(n, float(metrics.get_metric_function(n)(x, "y", "p")))], "metric string, value double").select("metric", F.round("value", k).alias("value")) for n, (_e, k) in _NUMBER_VALUES.items()]
    return reduce(DataFrame.unionByName, each)


@query("under_errors", "SELECT o_orderkey, round(o_totalprice * 0.1 - o_orderkey % 7 * 20000, 4) AS error FROM orders WHERE o_totalprice * 0.1 - o_orderkey % 7 * 20000 < 0 ORDER BY 2, 1 LIMIT 15")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 0.9 + F.col("o_orderkey") % 7 * 20000).alias("p"))
    return rounded(report.get_top_regression_under_over_errors(o, "o_totalprice", "p")[1].select("o_orderkey", "error"), 4)


@query("streaming_case", "SELECT o_orderkey, lower(o_orderpriority) AS o_orderpriority FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    """All files of the folder that hold orders, as a stream through a fitted operator."""
    like = load(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    fitted = convert.CaseNormalizer(["o_orderpriority"], "lower").fit(like)
    stream = apply.stream_table(spark, f"{d}/order*.parquet", like)
    return apply.streamed(stream, fitted)
