"""Queries of the chart data steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.catalog import table
from quillmark.functions import quantity
from quillmark.operators import charts

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _rounded(df: DataFrame, *columns: str, places: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("""
SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) AS n,
 round(count(*) OVER (PARTITION BY l_returnflag ORDER BY l_quantity RANGE UNBOUNDED PRECEDING) / count(*) OVER (PARTITION BY l_returnflag), 6) AS share FROM lineitem""")
def ecdf(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.ecdf(table(spark, d, "lineitem"), "l_quantity", ["l_returnflag"]), "share", places=6)


_MONTHS = "SELECT date_trunc('month', o_orderdate)::DATE AS m, round(sum(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END), 2) AS amount FROM orders GROUP BY 1"


@query(f"""
WITH a AS ({_MONTHS}), w AS (SELECT m, amount, row_number() OVER (ORDER BY m) AS ordinal, coalesce(sum(amount) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM a)
SELECT ordinal, round(s, 2) AS start, round(s + amount, 2) AS "end", CASE WHEN amount >= 0 THEN 'increase' ELSE 'decrease' END AS class FROM w""")
def waterfall(spark: SparkSession, d: str) -> DataFrame:
    signed = F.when(F.col("o_orderstatus") == "F", -F.col("o_totalprice")).otherwise(F.col("o_totalprice"))
    months = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "month").alias("m")).agg(F.round(F.sum(signed), 2).alias("amount"))
    return _rounded(charts.waterfall(months, "amount", "m"), "start", "end", places=2).select("ordinal", "start", "end", "class")


@query("""
WITH v AS (SELECT o_orderpriority AS x, o_orderstatus AS s, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2),
w AS (SELECT x, s, v, coalesce(sum(v) OVER (PARTITION BY x ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS y0, sum(v) OVER (PARTITION BY x) AS t FROM v)
SELECT x, s, round(y0 / t, 6) AS y0, round((y0 + v) / t, 6) AS y1 FROM w""")
def stack_normalize(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("s")).agg(F.sum("o_totalprice").alias("v"))
    return _rounded(charts.stack(v, "x", "s", "v", "normalize"), "y0", "y1", places=6).select("x", "s", "y0", "y1")


@query("""
WITH v AS (SELECT o_orderpriority AS x, o_orderstatus AS s, count(*)::DOUBLE AS v FROM orders GROUP BY 1, 2),
w AS (SELECT x, s, v, coalesce(sum(v) OVER (PARTITION BY x ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - sum(v) OVER (PARTITION BY x) / 2 AS y0 FROM v)
SELECT x, s, y0, y0 + v AS y1 FROM w""")
def stack_center(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("x"), F.col("o_orderstatus").alias("s")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return charts.stack(v, "x", "s", "v", "center").select("x", "s", "y0", "y1")


@query("""
WITH v AS (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_linestatus, round(value / sum(value) OVER (PARTITION BY l_returnflag), 6) AS share FROM v""")
def share_of_total(spark: SparkSession, d: str) -> DataFrame:
    v = charts.grouped(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return _rounded(charts.share_of_total(v, "value", ["l_returnflag"]), "share", places=6).select("l_returnflag", "l_linestatus", "share")


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1")
def grouped_mean(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.grouped(table(spark, d, "customer"), ["c_mktsegment"], "c_acctbal", mean=True), "value")


@query("""
WITH a AS (SELECT p_brand, sum(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY value DESC, p_brand) AS rank, count(*) OVER () AS k FROM a)
SELECT CASE WHEN rank >= 6 AND k > 6 THEN 'Others (+' || (k - 5) || ')' ELSE p_brand END AS p_brand, least(rank, 6)::INT AS rank, rank >= 6 AND k > 6 AS is_others, sum(value) AS value FROM r GROUP BY 1, 2, 3""")
def topn_others(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return charts.top_with_others(rows, "p_brand", "l_quantity", 6)


@query("""
WITH a AS (SELECT p_brand FROM (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1 ORDER BY v DESC, p_brand LIMIT 4)), b AS (SELECT * FROM part SEMI JOIN a USING (p_brand)),
t AS (SELECT p_type FROM b GROUP BY 1 ORDER BY 1 LIMIT 3) SELECT p_partkey, p_brand, p_type FROM b SEMI JOIN t USING (p_type)""")
def overflow_trim(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_retailprice")
    return charts.overflow_trim(part, [("p_brand", 4, "value"), ("p_type", 3, "lexical")], "p_retailprice").select("p_partkey", "p_brand", "p_type")


@query("""
WITH k AS (SELECT DISTINCT p_brand FROM part), r AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) AS rn, count(*) OVER () AS n FROM k)
SELECT p_partkey, p_brand FROM part SEMI JOIN (SELECT p_brand FROM r WHERE rn > greatest(0, least(3, n - 5)) AND rn <= greatest(0, least(3, n - 5)) + 5) USING (p_brand)""")
def category_viewport(spark: SparkSession, d: str) -> DataFrame:
    return charts.viewport(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", 3, 5)


@query("""
SELECT floor(l_extendedprice / s) * s AS bin_start, (floor(l_extendedprice / s) + 1) * s AS bin_end, count(*) AS n FROM lineitem, (
 SELECT min(x) AS s FROM (SELECT k * pow(10, floor(log10((max(l_extendedprice) - min(l_extendedprice)) / 12))) AS x, max(l_extendedprice) - min(l_extendedprice) AS r FROM lineitem, (VALUES (1), (2), (5), (10), (20)) v(k) GROUP BY k) WHERE r / x <= 12) GROUP BY 1, 2""")
def histogram_bins(spark: SparkSession, d: str) -> DataFrame:
    return charts.histogram(table(spark, d, "lineitem"), "l_extendedprice", 12)


@query("""
SELECT l_returnflag, p, round(q, 4) AS q FROM (SELECT l_returnflag, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS p, unnest(quantile_cont(l_extendedprice, [0.1, 0.5, 0.9])) AS q FROM lineitem GROUP BY 1)""")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.1, 0.5, 0.9], ["l_returnflag"]), "q")


@query("""
WITH q AS (SELECT o_orderpriority AS g, quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders GROUP BY 1),
r AS (SELECT g, o_totalprice AS v, q1, median, q3, o_totalprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM orders JOIN q ON g = o_orderpriority)
SELECT g AS o_orderpriority, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, min(v) FILTER (ok) AS low, max(v) FILTER (ok) AS high, count(*) AS n, count(*) FILTER (NOT ok) AS outliers FROM r GROUP BY 1, 2, 3, 4""")
def boxplot_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.boxplot(table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"]), "q1", "median", "q3")


@query("""
SELECT c_mktsegment, round(1.06 * CASE WHEN i > 0 THEN least(s, i / 1.34) ELSE s END * pow(n, -0.2), 4) AS bandwidth FROM (
 SELECT c_mktsegment, stddev_samp(c_acctbal) AS s, count(*) AS n, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS i FROM customer GROUP BY 1)""")
def kde_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.bandwidth(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"]), "bandwidth")


@query("""
WITH r AS (SELECT c_mktsegment, c_acctbal AS v, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) - 1 AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
q AS (SELECT c_mktsegment, stddev_pop(v) AS s, count(*) AS n, max(v) FILTER (rn = floor(n * 0.75)) - max(v) FILTER (rn = floor(n * 0.25)) AS i FROM r GROUP BY 1)
SELECT c_mktsegment, round(1.06 * CASE WHEN i > 0 THEN least(s, i / 1.34) ELSE s END * pow(n, -0.2), 4) AS bandwidth FROM q""")
def density_bandwidth(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.bandwidth(table(spark, d, "customer"), "c_acctbal", ["c_mktsegment"], population=True), "bandwidth")


@query("""
WITH g AS (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier), x AS (SELECT lo + i * ((hi - lo) / 20) AS x FROM g, range(0, 21) t(i))
SELECT round(x, 4) AS x, round(avg(exp(-0.5 * pow((x - s_acctbal) / 500, 2)) / (500 * sqrt(2 * pi()))), 10) AS density FROM x, supplier GROUP BY x.x""")
def density_grid(spark: SparkSession, d: str) -> DataFrame:
    out = charts.density(table(spark, d, "supplier"), "s_acctbal", 500.0, 20)
    return out.select(F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@query("""
SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem GROUP BY 1""")
def regression_linear(spark: SparkSession, d: str) -> DataFrame:
    out = charts.regression(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return _rounded(_rounded(_rounded(out, "intercept", places=3), "slope"), "r2", places=6)


@query("""
SELECT round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 4) AS intercept, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 4) AS slope, count(*) AS n FROM lineitem""")
def regression_power(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.regression(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", method="pow").drop("r2"), "intercept", "slope")


@query("""
WITH s AS (
  SELECT l_returnflag, count(*)::DOUBLE AS n, sum(x) AS a, sum(x * x) AS b, sum(x * x * x) AS c, sum(x * x * x * x) AS d, sum(y) AS p, sum(x * y) AS q, sum(x * x * y) AS r
  FROM (SELECT l_returnflag, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem) GROUP BY 1),
e AS (SELECT *, n * (b * d - c * c) - a * (a * d - b * c) + b * (a * c - b * b) AS det FROM s)
SELECT l_returnflag, n::BIGINT AS n, round((p * (b * d - c * c) - a * (q * d - c * r) + b * (q * c - b * r)) / det, 1) AS c0,
  round((n * (q * d - r * c) - p * (a * d - b * c) + b * (a * r - b * q)) / det, 2) AS c1, round((n * (b * r - c * q) - a * (a * r - b * q) + p * (a * c - b * b)) / det, 3) AS c2 FROM e""")
def regression_quadratic(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    fit = charts.regression(rows, "x", "y", ["l_returnflag"], method="quad")
    return fit.select("l_returnflag", "n", *[F.round(F.col("coefficients")[i], p).alias(f"c{i}") for i, p in enumerate((1, 2, 3))])


@query("""
SELECT c_nationkey AS label, max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS x, max(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS y FROM customer GROUP BY 1
HAVING max(c_acctbal) FILTER (c_mktsegment = 'BUILDING') IS NOT NULL AND max(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') IS NOT NULL""")
def scatter_pivot(spark: SparkSession, d: str) -> DataFrame:
    return charts.pairs_wide(table(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", "BUILDING", "MACHINERY").withColumnRenamed("c_nationkey", "label")


@query("""
WITH s AS (SELECT DISTINCT o_orderstatus AS s FROM orders ORDER BY 1 LIMIT 2)
SELECT o_orderpriority, coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = (SELECT min(s) FROM s)), 2), 0) AS "left", coalesce(round(sum(o_totalprice) FILTER (o_orderstatus = (SELECT max(s) FROM s)), 2), 0) AS "right" FROM orders GROUP BY 1""")
def pyramid_two_sides(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.pyramid(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice"), "left", "right", places=2)


@query("""
SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def wide_to_grouped(spark: SparkSession, d: str) -> DataFrame:
    return charts.unpivot(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"])


@query("""
WITH p AS (SELECT s_nationkey, sum(CASE WHEN s_acctbal >= 0 THEN s_acctbal ELSE 0 END) AS p, sum(CASE WHEN s_acctbal < 0 THEN s_acctbal ELSE 0 END) AS m FROM supplier GROUP BY 1)
SELECT round(max(p), 2) AS highest, round(min(m), 2) AS lowest FROM p""")
def signed_stack_extremes(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.signed_extremes(table(spark, d, "supplier"), "s_nationkey", "s_acctbal"), "highest", "lowest", places=2)


@query("""
WITH v AS (SELECT DISTINCT p_retailprice AS v FROM part), g AS (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM v) SELECT round(min(g) FILTER (g > 0), 6) AS min_gap FROM g""")
def min_gap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.min_gap(table(spark, d, "part"), "p_retailprice"), "min_gap", places=6)


@query("""
WITH v AS (SELECT DISTINCT p_size AS v FROM part), g AS (SELECT v - lag(v) OVER (ORDER BY v) AS g FROM v), s AS (SELECT list_sort(list(g) FILTER (g IS NOT NULL)) AS l FROM g)
SELECT len(l) > 0 AND len([x for x in l if abs(x - l[len(l) // 2 + 1]) > 0.01 * abs(l[len(l) // 2 + 1])]) = 0 AS equal FROM s""")
def equal_stride(spark: SparkSession, d: str) -> DataFrame:
    return charts.equal_stride(table(spark, d, "part"), "p_size")


@query("""
WITH y AS (SELECT year(o_orderdate)::BIGINT AS y, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT a.y AS first_year, b.y AS last_year, round(pow(b.v / a.v, 1.0 / (b.y - a.y)) - 1, 6) AS rate FROM y a JOIN y b ON b.y > a.y""")
def cagr_check(spark: SparkSession, d: str) -> DataFrame:
    y = table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    a, b = y.toDF("first_year", "va"), y.toDF("last_year", "vb")
    years = F.col("last_year") - F.col("first_year")
    return a.join(F.broadcast(b), years > 0).select("first_year", "last_year", F.round(quantity.growth_rate(F.col("va"), F.col("vb"), years), 6).alias("rate"))


@query("""
SELECT o_custkey, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS "close",
 CASE WHEN first(o_totalprice ORDER BY o_orderdate, o_orderkey) = last(o_totalprice ORDER BY o_orderdate, o_orderkey) THEN 'doji' WHEN first(o_totalprice ORDER BY o_orderdate, o_orderkey) < last(o_totalprice ORDER BY o_orderdate, o_orderkey) THEN 'up' ELSE 'down' END AS direction
FROM orders GROUP BY 1""")
def candlestick(spark: SparkSession, d: str) -> DataFrame:
    return charts.candles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderdate", "o_orderkey")


@query("""
WITH r AS (SELECT r_name AS g, o_orderpriority AS a, avg(o_totalprice) AS m, max(o_totalprice) AS hi FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
x AS (SELECT a, max(hi) AS h, pow(10, floor(log10(max(hi)))) AS b FROM r GROUP BY 1), n AS (SELECT a, b * CASE WHEN h / b <= 1 THEN 1 WHEN h / b <= 2 THEN 2 WHEN h / b <= 2.5 THEN 2.5 WHEN h / b <= 5 THEN 5 ELSE 10 END AS top FROM x)
SELECT g, a, round(m / top, 6) AS share, round(m, 2) AS mean FROM r JOIN n USING (a)""")
def radar(spark: SparkSession, d: str) -> DataFrame:
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    out = charts.radar(rows.select(F.col("r_name").alias("g"), F.col("o_orderpriority").alias("a"), "o_totalprice"), "g", "a", "o_totalprice")
    return _rounded(out, "share", places=6).select("g", "a", "share", "mean")


@query("""
SELECT least(100.0, sum(s_acctbal) FILTER (s_acctbal > 0) / min(s_acctbal) FILTER (s_acctbal > 0)) AS bars FROM supplier""")
def effective_bars(spark: SparkSession, d: str) -> DataFrame:
    return charts.effective_bars(table(spark, d, "supplier"), "s_acctbal")


@query("SELECT round(log10(max(l_extendedprice)) - log10(min(l_extendedprice)), 6) AS decades FROM lineitem WHERE l_extendedprice > 0")
def log_decades(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.log_decades(table(spark, d, "lineitem"), "l_extendedprice"), "decades", places=6)


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(min(o_totalprice) + (max(o_totalprice) - min(o_totalprice)) * 0.6, 4) AS strong FROM orders")
def heat_domain(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.heat_domain(table(spark, d, "orders"), "o_totalprice"), "strong")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 5000 THEN 'met' ELSE 'below' END AS status, 1250.0 AS band_25, 2500.0 AS band_50, 3750.0 AS band_75 FROM customer")
def bullet_bands(spark: SparkSession, d: str) -> DataFrame:
    return charts.bullet(table(spark, d, "customer").select("c_custkey", "c_acctbal", F.lit(5000.0).alias("goal")), "c_acctbal", "goal").select("c_custkey", "status", "band_25", "band_50", "band_75")


@query("SELECT c_nationkey, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1")
def ranged_dots(spark: SparkSession, d: str) -> DataFrame:
    return charts.ranged(table(spark, d, "customer"), "c_nationkey", "c_acctbal")


@query("SELECT max(n) > 1 AS repeated FROM (SELECT count(*) AS n FROM part GROUP BY p_brand, p_type)")
def repeated_categories(spark: SparkSession, d: str) -> DataFrame:
    return charts.repeated_categories(table(spark, d, "part"), "p_brand", "p_type")


@query("SELECT count(DISTINCT p_type) AS n, max(length(p_type)) AS longest, false AS numeric FROM part")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    return charts.label_stats(table(spark, d, "part"), "p_type")


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 10")
def top_orders(spark: SparkSession, d: str) -> DataFrame:
    return charts.top_n(table(spark, d, "orders"), 10, F.desc("o_totalprice"), F.col("o_orderkey"))[0].select("o_orderkey", "o_totalprice")


@query("""
WITH b AS (SELECT p_size::DOUBLE AS x, avg(p_retailprice) AS y, row_number() OVER (ORDER BY p_size) - 1 AS rn FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY p_size),
m AS (SELECT k, rn // (1 << k) AS b, avg(x) AS x, avg(y) AS y FROM b, (VALUES (0), (1), (2)) AS s(k) GROUP BY 1, 2),
g AS (SELECT k, abs((y - lag(y) OVER w) / nullif(x - lag(x) OVER w, 0)) AS s FROM m WINDOW w AS (PARTITION BY k ORDER BY b)),
q AS (SELECT k, median(s) AS m FROM g GROUP BY 1 HAVING median(s) > 0)
SELECT round(exp(avg(ln(m))), 4) AS slope FROM q""")
def median_slope(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(charts.median_slope(table(spark, d, "part"), "p_size", "p_retailprice"), "slope", places=4)


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part) SELECT p_brand, p_partkey, rn::INT AS rank FROM r WHERE rn <= 4""")
def per_page_top(spark: SparkSession, d: str) -> DataFrame:
    return charts.top_n(table(spark, d, "part"), 4, F.desc("p_retailprice"), F.col("p_partkey"), by=["p_brand"])[0].select("p_brand", "p_partkey", "rank")
