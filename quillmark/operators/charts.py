"""Data steps of charts: what the rows must be before anything is drawn."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators import ordering, selection


def _w(by: list[str]) -> Window:
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values of each group with n (rows up to it) and share of the group.

    Rows are counted per value first, so only distinct values are sorted."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(_w(by).orderBy(value))
    return counts.select(*by, value, run.alias("n"), (run / F.sum("_n").over(_w(by))).alias("share"))


def waterfall(df: DataFrame, amount: str, order: str, total_last: bool = False) -> DataFrame:
    """start, end and class (increase, decrease, total) of each bar in the order of a column
    without repeats. total_last: the last row restates the running total."""
    a = F.coalesce(F.col(amount), F.lit(0.0))
    placed = ordering.running_sum(ordering.numbered(df, "ordinal", [order]), "_before", a, [order])
    last = (F.col("ordinal") == F.lit(df.count() if total_last else -1))
    start = F.when(last, 0.0).otherwise(F.col("_before"))
    return placed.select(*df.columns, "ordinal", start.alias("start"), (start + a).alias("end"), F.when(last, "total").when(a >= 0, "increase").otherwise("decrease").alias("class"))


def stack(df: DataFrame, x: str, series: str, value: str, mode: str = "zero") -> DataFrame:
    """y0, y1 of each segment: zero, normalize (shares of the bar), center, or layered."""
    w = Window.partitionBy(x)
    v = F.coalesce(F.col(value), F.lit(0.0))
    if mode == "layered":
        return df.select("*", F.lit(0.0).alias("y0"), v.alias("y1"))
    y0 = F.coalesce(F.sum(v).over(w.orderBy(series).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum(v).over(w)
    if mode == "normalize":
        return df.select("*", (y0 / F.nullif(total, F.lit(0.0))).alias("y0"), ((y0 + v) / F.nullif(total, F.lit(0.0))).alias("y1"))
    shift = total / 2 if mode == "center" else F.lit(0.0)
    return df.select("*", (y0 - shift).alias("y0"), (y0 + v - shift).alias("y1"))


def share_of_total(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Each row's share of its group's total, null where that is 0."""
    return df.withColumn("share", F.col(value) / F.nullif(F.sum(value).over(_w(by)), F.lit(0.0)))


def grouped(df: DataFrame, by: list[str], value: str | None, mean: bool = False) -> DataFrame:
    """by, n, value: sum, or mean for measures that don't add up; rows where there is none."""
    n = F.count(F.lit(1))
    v = n.cast("double") if value is None else (F.sum(value) / F.count(value) if mean else F.sum(value))
    return df.groupBy(*by).agg(n.alias("n"), v.alias("value"))


def top_with_others(df: DataFrame, category: str, value: str, n: int, by: list[str] = [], mean: bool = False, others: str = "Others") -> DataFrame:  # noqa: B006
    """by, category, value, rank, is_others: the n - 1 largest categories of each group and one
    row for the rest (sum, or mean of the rest), if there is more than one."""
    agg = df.groupBy(*by, category).agg((F.avg(value) if mean else F.sum(value)).alias("value"))
    rank = F.row_number().over(_w(by).orderBy(F.desc("value"), category))
    ranked = agg.withColumns({"rank": rank, "_all": F.count(F.lit(1)).over(_w(by))})
    rest = (F.col("rank") >= n) & (F.col("_all") > n)
    name = F.when(rest, F.concat(F.lit(f"{others} (+"), (F.col("_all") - (n - 1)).cast("string"), F.lit(")"))).otherwise(F.col(category))
    out = ranked.withColumns({category: name, "rank": F.when(rest, F.lit(n)).otherwise(F.col("rank")), "is_others": rest})
    return out.groupBy(*by, category, "rank", "is_others").agg((F.avg("value") if mean else F.sum("value")).alias("value"))


def top_n(df: DataFrame, n: int, *order: Column, by: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(the first n rows, the dropped ones), both with their rank."""
    ranked = df.withColumn("rank", F.row_number().over(_w(by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n), ranked.where(F.col("rank") > n)


def overflow_trim(df: DataFrame, channels: list[tuple[str, int, str]], value: str | None = None, bar: bool = True) -> DataFrame:
    """Rows of the categories that fit each channel, one channel after the other.

    channels: (column, most, order), where order is value (sum for bars, else maximum, of the
    value), numeric, lexical or first (by the column _ordinal)."""
    for column, most, order in channels:
        keys = df.groupBy(column).agg(*[x.alias(n) for n, x in {
            "value": (F.sum(value) if bar else F.max(value)) if value else F.lit(0),
            "first": F.min("_ordinal") if "_ordinal" in df.columns else F.lit(0),
        }.items()])
        by = {"value": [F.desc("value")], "numeric": [F.col(column).try_cast("double").asc_nulls_last()], "lexical": [], "first": [F.col("first")]}[order]
        kept = keys.orderBy(*by, column).limit(most).select(column)
        df = df.join(F.broadcast(kept), column, "left_semi")  # at most `most` rows
    return df


def viewport(df: DataFrame, category: str, offset: int, size: int) -> DataFrame:
    """Rows of the categories offset .. offset + size - 1 in lexical order; a window that
    would end beyond the last category is moved back."""
    keys = df.select(category).distinct()
    start = max(0, min(offset, keys.count() - size))
    return df.join(keys.orderBy(category).offset(start).limit(size), category, "left_semi")


def signed_extremes(df: DataFrame, x: str, value: str) -> DataFrame:
    """One row: highest, lowest: the largest sum of positive and the smallest of negative
    values of any stack."""
    per = df.groupBy(x).agg(F.sum(F.when(F.col(value) >= 0, F.col(value)).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(value) < 0, F.col(value)).otherwise(0.0)).alias("m"))
    return per.agg(F.max("p").alias("highest"), F.min("m").alias("lowest"))


def repeated_categories(df: DataFrame, *columns: str) -> DataFrame:
    """One row: repeated: a combination occurs more than once."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.bool_or(F.col("n") > 1), F.lit(False)).alias("repeated"))


def nice_step(lo: float, hi: float, most: int) -> float:
    """The smallest of 1, 2, 5 times a power of ten that needs at most `most` bins."""
    if not hi > lo:
        return 1.0
    step = 10.0 ** math.floor(math.log10((hi - lo) / most))
    for k in (1, 2, 5, 10, 20):
        if (hi - lo) / (step * k) <= most:
            return step * k
    return step * 50


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin_start, bin_end, n with a nice step; empty bins are left out. One pass for the
    extent, one aggregation; the largest value lies in the bin it starts or in the last one."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin_start double, bin_end double, n long")
    step = nice_step(float(lo), float(hi), bins)
    at = F.floor(F.col(value) / step)
    return df.where(F.col(value).isNotNull()).groupBy(at.alias("_b")).agg(F.count(F.lit(1)).alias("n")).select((F.col("_b") * step).alias("bin_start"), ((F.col("_b") + 1) * step).alias("bin_end"), "n")


def quantiles(df: DataFrame, value: str, ps: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, p, q: exact, linearly interpolated; see selection for groups of any size."""
    q = selection.order_statistics(df, value, {f"q{i}": ("at", p) for i, p in enumerate(ps)}, by)
    return q.select(*by, F.explode(F.array(*[F.struct(F.lit(float(p)).alias("p"), F.col(f"q{i}").alias("q")) for i, p in enumerate(ps)])).alias("x")).select(*by, "x.p", "x.q")


def boxplot(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """q1, median, q3, whiskers (the farthest rows within 1.5 times the box), n and outliers."""
    box = selection.order_statistics(df, value, {"q1": ("at", 0.25), "median": ("at", 0.5), "q3": ("at", 0.75)}, by).drop("n")
    # a group's rows meet its box in many tasks
    shares = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(selection.SHARES - 1).cast("long")))
    dealt = df.select(*by, value).withColumn("_share", F.pmod(F.xxhash64(value), F.lit(selection.SHARES)))
    rows = dealt.join(box.withColumn("_share", shares), [*by, "_share"]) if by else df.select(value).crossJoin(F.broadcast(box))
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return rows.groupBy(*by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count(value).alias("n"), F.count_if(~inside).alias("outliers")
    )


def bandwidth(df: DataFrame, value: str, by: list[str], population: bool = False) -> DataFrame:
    """by, bandwidth: 1.06 min(sd, IQR / 1.34) n^-0.2. population: population deviation and
    quartiles by index instead of sample deviation and interpolation."""
    sd = F.stddev_pop(value) if population else F.stddev_samp(value)
    kind = "index" if population else "at"
    box = selection.order_statistics(df, value, {"_lo": (kind, 0.25), "_hi": (kind, 0.75)}, by).drop("n")
    base = df.groupBy(*by).agg(sd.alias("_sd"), F.count(value).alias("_n"))
    base = (base.join(box, by) if by else base.join(F.broadcast(box))).withColumn("_iqr", F.col("_hi") - F.col("_lo"))
    spread = F.when(F.col("_iqr") > 0, F.least("_sd", F.col("_iqr") / 1.34)).otherwise(F.col("_sd"))
    return base.select(*by, (1.06 * spread * F.pow("_n", F.lit(-0.2))).alias("bandwidth"))


def density(df: DataFrame, value: str, width: float, steps: int = 50) -> DataFrame:
    """x, density on a grid over the extent, Gaussian kernel. Values are counted per distinct
    value first; the grid is an array in each row, not a join."""
    lo, hi = df.agg(F.min(value), F.max(value)).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "x double, density double")
    grid = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.lit(float(lo)) + i * ((float(hi) - float(lo)) / steps))
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    rows = counts.select(value, "_n", F.explode(grid).alias("x"))
    z = (F.col("x") - F.col(value)) / width
    return rows.groupBy("x").agg((F.sum(F.col("_n") * F.exp(-0.5 * z * z)) / (F.sum("_n") * width * math.sqrt(2 * math.pi))).alias("density"))


def regression(df: DataFrame, x: str, y: str, by: list[str] = [], method: str = "linear", order: int = 3) -> DataFrame:  # noqa: B006
    """by, intercept, slope, r2, n for linear, log, exp and pow; by, coefficients (from the
    constant up), n for quad and poly. Polynomials are solved from power sums, which combine on
    the map side; only those few numbers of a group meet in Python."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if method in ("quad", "poly"):
        k = 2 if method == "quad" else order
        if not 1 <= k <= 10:
            raise ValueError("a polynomial has degree 1 to 10")
        sums = rows.groupBy(*by).agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(F.pow(x, F.lit(float(i)))) for i in range(2 * k + 1)]).alias("_x"),
            F.array(*[F.sum(F.pow(x, F.lit(float(i))) * F.col(y)) for i in range(k + 1)]).alias("_y"),
        )

        @F.udf("array<double>", useArrow=True)
        def solve(xs, ys):
            import numpy as np

            a = np.array([[xs[i + j] for j in range(k + 1)] for i in range(k + 1)], float)
            return np.linalg.lstsq(a, np.array(ys, float), rcond=None)[0].tolist()

        return sums.select(*by, solve("_x", "_y").alias("coefficients"), "n")
    fx = F.ln(F.col(x)) if method in ("log", "pow") else F.col(x)
    fy = F.ln(F.col(y)) if method in ("exp", "pow") else F.col(y)
    out = rows.select(*by, fx.alias("_x"), fy.alias("_y")).where("_x is not null and _y is not null").groupBy(*by)
    return out.agg(F.regr_intercept("_y", "_x").alias("intercept"), F.regr_slope("_y", "_x").alias("slope"), F.regr_r2("_y", "_x").alias("r2"), F.count(F.lit(1)).alias("n"))


def gaps(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the gap to the one before."""
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct()
    return ordering.with_previous(distinct, "_last", value).select(value, (F.col(value) - F.col("_last")).alias("gap"))


def min_gap(df: DataFrame, value: str) -> DataFrame:
    return gaps(df, value).agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("min_gap"))


def equal_stride(df: DataFrame, value: str, tolerance: float = 0.01) -> DataFrame:
    """One row: equal: every gap is within 1 % of the (upper) median gap. Gaps are counted per
    value; of equal strides there are few."""
    sizes = gaps(df, value).where("gap is not null").groupBy("gap").agg(F.count(F.lit(1)).alias("_n"))
    n = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    through = ordering.running_sum(sizes, "_before", F.col("_n"), ["gap"])
    middle = through.where((F.col("_before") <= n // 2) & (F.col("_before") + F.col("_n") > n // 2)).select(F.col("gap").alias("_mid"))
    far = F.abs(F.col("gap") - F.col("_mid")) > tolerance * F.abs("_mid")
    checked = sizes.crossJoin(F.broadcast(middle))  # the one median gap
    return checked.agg(((F.count(F.lit(1)) > 0) & ~F.coalesce(F.bool_or(far), F.lit(False))).alias("equal"))


def padded_extent(df: DataFrame, value: str) -> DataFrame:
    lo, hi = F.min(value), F.max(value)
    return df.agg(F.when(lo == hi, lo - 0.5).otherwise(lo).alias("lo"), F.when(lo == hi, hi + 0.5).otherwise(hi).alias("hi"))


def effective_bars(df: DataFrame, value: str, most: int = 100) -> DataFrame:
    """One row: bars: sum of positive values over the smallest one, at most `most`."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.agg(F.least(F.lit(float(most)), F.sum(v) / F.min(v)).alias("bars"))


def nice_max(x: Column) -> Column:
    """x rounded up to 1, 2, 2.5, 5 or 10 times a power of ten."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    m = x / base
    return F.when(x <= 0, 1.0).otherwise(F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 2.5, 2.5).when(m <= 5, 5.0).otherwise(10.0) * base)


def radar(df: DataFrame, group: str, axis: str, value: str) -> DataFrame:
    """group, axis, share (mean of value / axis maximum), mean, x, y. What isn't a number counts
    as 0; axes lie in lexical order around the circle."""
    v = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    rows = df.groupBy(group, axis).agg(F.avg(v).alias("_m"), F.max(v).alias("_hi"))
    rows = rows.withColumns({"_max": nice_max(F.max("_hi").over(Window.partitionBy(axis))), "_i": F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy(axis)) - 1})
    rows = rows.withColumn("_n", F.max("_i").over(Window.partitionBy(F.lit(1))) + 1)
    share = F.col("_m") / F.col("_max")
    angle = 2 * math.pi * F.col("_i") / F.col("_n") - math.pi / 2
    return rows.select(group, axis, share.alias("share"), F.round("_m", 2).alias("mean"), (share * F.cos(angle)).alias("x"), (share * F.sin(angle)).alias("y"))


def candles(df: DataFrame, by: list[str], price: str, *order: str) -> DataFrame:
    """by, open, high, low, close, direction (up, down or doji), from ticks."""
    at = F.struct(*order)
    out = df.groupBy(*by).agg(F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"))
    return out.withColumn("direction", F.when(F.col("open") == F.col("close"), "doji").when(F.col("open") < F.col("close"), "up").otherwise("down"))


def kpi(value: Column, goal: Column, behind: float = 0.9) -> Column:
    """struct progress, status: value / goal, null for goal 0; met, near or behind."""
    p = F.try_divide(value, goal)
    return F.struct(p.alias("progress"), F.when(p >= 1, "met").when(p >= behind, "near").when(p.isNotNull(), "behind").alias("status"))


def bullet(df: DataFrame, value: str, goal: str) -> DataFrame:
    """Rows with bands at 25, 50 and 75 % of the goal and whether it is met."""
    return df.select("*", *[(F.col(goal) * p).alias(f"band_{int(p * 100)}") for p in (0.25, 0.5, 0.75)], F.when(F.col(value) >= F.col(goal), "met").otherwise("below").alias("status"))


def ranged(df: DataFrame, category: str, value: str) -> DataFrame:
    return df.groupBy(category).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def pyramid(df: DataFrame, side: str, category: str, value: str) -> DataFrame:
    """category, left, right: the sums of the first two sides (in lexical order)."""
    sides = [r[0] for r in df.select(side).where(F.col(side).isNotNull()).distinct().orderBy(side).limit(2).collect()]
    pick = lambda i: F.coalesce(F.sum(F.when(F.col(side) == sides[i], F.col(value))), F.lit(0.0)) if i < len(sides) else F.lit(0.0)
    return df.groupBy(category).agg(pick(0).alias("left"), pick(1).alias("right"))


def pairs_wide(df: DataFrame, label: str, series: str, value: str, x: str, y: str) -> DataFrame:
    """label, x, y for labels that have both series."""
    out = df.groupBy(label).agg(*[F.max(F.when(F.col(series) == s, F.col(value))).alias(n) for s, n in ((x, "x"), (y, "y"))])
    return out.where("x is not null and y is not null")


def unpivot(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "name", "value")


def us_scope(df: DataFrame, lat: str, lon: str) -> DataFrame:
    """One row: scope: us if every point lies in the United States' box, else world."""
    outside = ~(F.col(lat).between(18.0, 72.0) & F.col(lon).between(-180.0, -65.0))
    return df.agg(F.when(F.coalesce(F.bool_or(outside), F.lit(True)), "world").otherwise("us").alias("scope"))


def jitter(df: DataFrame, name: str = "jitter", seed: int = 1) -> DataFrame:
    return df.withColumn(name, F.rand(seed) - 0.5)


def log_decades(df: DataFrame, value: str) -> DataFrame:
    """One row: decades between the smallest and largest positive value, with two at least."""
    v = F.when(F.col(value) > 0, F.col(value))
    return df.agg(F.when(F.count(v) >= 2, F.log10(F.max(v)) - F.log10(F.min(v))).alias("decades"))


def pair_coverage(df: DataFrame, x: str, y: str, zero: bool = False) -> DataFrame:
    """One row: n, x_share, y_share: rows where both parse, and the data's part of the domain
    (which reaches to zero if asked for)."""
    both = df.select(F.col(x).try_cast("double").alias("x"), F.col(y).try_cast("double").alias("y")).where("x is not null and y is not null")

    def share(c: str) -> Column:
        lo, hi = F.min(c), F.max(c)
        a, b = (F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))) if zero else (lo, hi)
        return F.try_divide(hi - lo, b - a)

    return both.agg(F.count(F.lit(1)).alias("n"), share("x").alias("x_share"), share("y").alias("y_share"))


def band_padding(df: DataFrame, value: str) -> DataFrame:
    """One row: pad: half a step of equally spaced distinct values."""
    return df.agg(((F.max(value) - F.min(value)) / (F.count_distinct(value) - 1) / 2).alias("pad"))


def heat_domain(df: DataFrame, value: str, diverging: bool = False) -> DataFrame:
    """One row: lo, hi, strong: colour domain (symmetric if diverging) and the value from
    which a cell is strong."""
    v = F.col(value).try_cast("double")
    lo, hi, m = F.min(v), F.max(v), F.greatest(F.abs(F.min(v)), F.abs(F.max(v)))
    if diverging:
        return df.agg((-m).alias("lo"), m.alias("hi"), (m * 0.5).alias("strong"))
    return df.agg(lo.alias("lo"), hi.alias("hi"), (lo + (hi - lo) * 0.6).alias("strong"))


def independent_scale(df: DataFrame, facet: str, value: str) -> DataFrame:
    """One row: independent: facets' largest values differ a hundredfold and are fewer than 6."""
    per = df.groupBy(facet).agg(F.max(F.abs(value)).alias("m"))
    return per.agg(((F.max("m") / F.min(F.when(F.col("m") > 0, F.col("m"))) >= 100) & (F.count(F.lit(1)) < 6)).alias("independent"))


def facet_grid(columns: int, rows: int, fit_columns: int, fit_rows: int) -> dict:
    """Columns and rows of panels that fit; a lone column facet wraps, without a last row of
    one panel where a narrower grid avoids it."""
    if rows <= 1 and columns > fit_columns:
        wide = fit_columns
        if wide > 2 and columns % wide == 1:
            wide -= 1
        high = min(-(-columns // wide), fit_rows)
        return {"columns": wide, "rows": high, "most": wide * high, "wrapped": True}
    return {"columns": min(columns, fit_columns), "rows": min(rows, fit_rows), "most": min(columns, fit_columns) * min(rows, fit_rows), "wrapped": False}


def median_slope(df: DataFrame, x: str, y: str, scales: int = 3) -> DataFrame:
    """One row: slope: geometric mean, over bucket sizes 1, 2, 4, .., of the median absolute
    slope between neighbouring bucket means."""
    one = Window.partitionBy(F.lit(1))
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(F.avg(y).alias("_y")).withColumn("_rn", F.row_number().over(one.orderBy(x)) - 1)
    rows = base.select(F.explode(F.sequence(F.lit(0), F.lit(scales - 1))).alias("k"), "_rn", F.col(x).cast("double").alias("_x"), "_y")
    means = rows.groupBy("k", F.floor(F.col("_rn") / F.pow(F.lit(2.0), F.col("k"))).alias("b")).agg(F.avg("_x").alias("_x"), F.avg("_y").alias("_y"))
    w = Window.partitionBy("k").orderBy("b")
    slope = F.abs((F.col("_y") - F.lag("_y").over(w)) / F.nullif(F.col("_x") - F.lag("_x").over(w), F.lit(0.0)))
    per = means.withColumn("_s", slope).groupBy("k").agg(F.median("_s").alias("m")).where("m > 0")
    return per.agg(F.exp(F.avg(F.ln("m"))).alias("slope"))


def dispersion_ratio(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: ratio of two columns' deviations, each over its range."""
    d = lambda c: F.try_divide(F.stddev_pop(c), F.max(c) - F.min(c))
    return df.agg(F.try_divide(d(a), d(b)).alias("ratio"))


def label_stats(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("string")
    return df.agg(F.count_distinct(c).alias("n"), F.max(F.length(c)).alias("longest"), F.coalesce(F.bool_and(c.try_cast("double").isNotNull()), F.lit(False)).alias("numeric"))


def axis_label(df: DataFrame, entity: str, period: str, fact_id: str) -> DataFrame:
    """df with label: the period if periods are unique, else the entity if they are, else both,
    with the id where even that repeats."""
    both = F.concat_ws(" · ", entity, period)
    n, periods, entities = df.agg(F.count(F.lit(1)), F.count_distinct(period), F.count_distinct(entity)).first()
    if n in (periods, entities):
        return df.withColumn("label", F.col(period if n == periods else entity))
    alone = F.count(F.lit(1)).over(Window.partitionBy(both)) == 1
    return df.withColumn("label", F.when(alone, both).otherwise(F.concat(both, F.lit(" "), F.col(fact_id))))


def same_unit(df: DataFrame, unit: str, raw: str) -> DataFrame:
    """df with value as a finite double; fails if units differ or a value isn't a number."""
    units = df.select(unit).distinct().limit(2).count()
    if units > 1:
        raise ValueError("rows of one chart need one unit")
    v = F.replace(F.col(raw), F.lit(","), F.lit("")).try_cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.withColumn("value", F.when(good, v).otherwise(F.raise_error(F.concat(F.lit("not a finite number: "), F.coalesce(F.col(raw), F.lit("null")))).cast("double")))


# Most categories, series, heat-map cells a side and slices of a chart.
LIMITS = {"category": 20, "series": 12, "heatmap": 25, "pie": 5}


def check_limits(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df; fails if the column has more values than that kind of channel can show."""
    n = df.agg(F.count_distinct(column)).first()[0]
    if n > LIMITS[kind]:
        raise ValueError(f"{n} values of {column}; a chart shows {LIMITS[kind]}: choose a top number")
    return df


def confirmed_rows(facts: DataFrame, ids: list[str]) -> DataFrame:
    """The confirmed facts asked for, in the order asked for; fails on any other id."""
    if len(set(ids)) != len(ids) or not all(ids):
        raise ValueError("fact ids must be unique and not empty")
    wanted = facts.sparkSession.createDataFrame(list(enumerate(ids)), "ordinal int, id string")
    found = F.broadcast(wanted).join(facts, "id", "left")  # as many rows as ids were given
    bad = F.when(~F.col("status").eqNullSafe("confirmed"), F.raise_error(F.concat(F.lit("not confirmed: "), F.col("id"))).cast("boolean")).otherwise(F.lit(True))
    return found.where(bad).orderBy("ordinal")
