"""Chart options: which apply to which column, sort wishes in layers, continuous colour, map scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# When an option is offered.
LOG_ROWS, LOG_SPAN = 5, 1000
CATEGORIES = (2, 50)
AXIS_TYPE_CHARTS = ("Bar Chart", "Line Chart", "Area Chart", "Lollipop Chart")
US_LON, US_LAT = (-170, -66), (18, 72)
SEMANTIC_SCOPE = {"State": "us", "Country": "world"}
DISCRETE = ("nominal", "ordinal")
CONTINUOUS = ("quantitative", "temporal")


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def column_facts(df: DataFrame, quantitative: list[str], temporal: list[str]) -> DataFrame:
    """column, n, negative, positive, low, high (of the positive), total and distinct: what the
    options ask of the data, for all columns in one aggregation.

    distinct is filled for temporal columns alone and is exact up to twice CATEGORIES; a column
    with more gets null: a sketch tells which columns those are, and only the others are
    counted exactly, in the same pass, by a set that the sketch's limit bounds."""
    most = 2 * CATEGORIES[1]
    sums = []
    for c in quantitative:
        v = _finite(c)
        positive = F.when(v > 0, v)
        sums.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.count_if(v < 0).alias("negative"), F.count(positive).alias("positive"), F.min(positive).alias("low"), F.max(positive).alias("high"), F.sum(v).alias("total"), F.lit(None).cast("long").alias("distinct")))
    rough = df.agg(*[F.approx_count_distinct(c, 0.01).alias(f"d{i}") for i, c in enumerate(temporal)]).first() if temporal else []
    few = [c for c, d in zip(temporal, rough, strict=True) if d <= most]
    for c in temporal:
        distinct = F.size(F.collect_set(F.nullif(F.col(c).cast("string"), F.lit("")))).cast("long") if c in few else F.lit(None).cast("long")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("low", "double"), ("high", "double"), ("total", "double"))]
        sums.append(F.struct(F.lit(c).alias("column"), F.count(F.col(c)).alias("n"), F.lit(0).cast("long").alias("negative"), F.lit(0).cast("long").alias("positive"), *none, distinct.alias("distinct")))
    return df.agg(F.array(*sums).alias("f")).select(F.explode("f").alias("f")).select("f.*")


def applicable(encodings: DataFrame, facts: DataFrame, choices: DataFrame | None = None) -> DataFrame:
    """chart, option, applicable, recommended: every option of every chart.

    encodings: chart, chart_type, mark (position or another), channel, column, type, scale, zero
    (the decision, null if there is none), zero_uncertain, aggregate. facts: as column_facts
    gives. choices: chart, option, value that the user has set: such an option stays offered.

    logScale_x/_y: no negative values, at least LOG_ROWS positive ones over a LOG_SPAN-fold range;
    recommended for a log or symlog scale. includeZero_x/_y: where the zero decision is uncertain;
    recommended as decided. xAxisType/yAxisType: temporal columns of 2 to 50 distinct values.
    independentYAxis: a quantitative y with a facet. showPercent: a total other than 0 of values
    of one sign that aren't averaged. Which charts have an option at all: log and zero those
    marked by position, axis types AXIS_TYPE_CHARTS, independentYAxis those with a facet channel,
    showPercent the bar table."""
    e = encodings.join(facts, "column", "left")
    quantitative = F.coalesce(F.col("type") == "quantitative", F.lit(False)) & F.col("column").isNotNull()
    spread = (F.col("negative") == 0) & (F.col("positive") >= LOG_ROWS) & (F.col("high") / F.col("low") >= LOG_SPAN)
    categories = (F.col("type") == "temporal") & F.col("distinct").between(*CATEGORIES)
    same_sign = (F.col("negative") == 0) | (F.col("positive") == 0)
    percent = quantitative & (F.col("n") > 0) & same_sign & (F.col("total") != 0) & ~F.col("aggregate").eqNullSafe("average")
    by_position = F.col("mark") == "position"
    axis = F.col("channel").isin("x", "y")
    facet = F.max(F.col("channel").isin("column", "row") & F.col("column").isNotNull()).over(Window.partitionBy("chart"))
    true, text = F.lit(True), lambda c: c.cast("string")
    yes = lambda c: F.coalesce(c, F.lit(False))
    option = lambda name, has, holds, chosen, recommended: F.when(has, F.struct(name.alias("option"), yes(holds).alias("holds"), chosen.alias("by_choice"), recommended.alias("recommended")))
    per_channel = F.array_compact(
        F.array(
            option(F.concat(F.lit("logScale_"), "channel"), by_position & axis, quantitative & spread, quantitative, F.when(quantitative, text(yes(F.col("scale").isin("log", "symlog"))))),
            option(F.concat(F.lit("includeZero_"), "channel"), by_position & axis, quantitative & F.col("zero").isNotNull() & F.col("zero_uncertain"), quantitative & F.col("zero").isNotNull(), F.when(quantitative, text(F.col("zero")))),
            option(F.concat(F.col("channel"), F.lit("AxisType")), F.col("chart_type").isin(*AXIS_TYPE_CHARTS) & axis, categories, F.col("column").isNotNull(), F.when(F.col("type") == "temporal", "temporal")),
            option(F.lit("independentYAxis"), (F.col("channel") == "y") & F.col("_facets"), quantitative & F.col("_facet"), F.lit(False), F.lit(None).cast("string")),
            option(F.lit("showPercent"), (F.col("chart_type") == "Bar Table") & (F.col("channel") == "x"), percent, F.lit(False), F.lit(None).cast("string")),
        )
    )
    has_facets = F.max(F.col("channel").isin("column", "row")).over(Window.partitionBy("chart"))
    rows = e.withColumns({"_facet": facet, "_facets": has_facets}).select("chart", F.explode(per_channel).alias("o")).select("chart", "o.*")
    if choices is not None:
        rows = rows.join(choices.select("chart", "option", F.lit(True).alias("_set")), ["chart", "option"], "left")
    else:
        rows = rows.withColumn("_set", F.lit(None).cast("boolean"))
    return rows.select("chart", "option", (F.col("holds") | (yes(F.col("_set")) & yes(F.col("by_choice")) & true)).alias("applicable"), "recommended")


def sort_channels(encodings: DataFrame) -> DataFrame:
    """chart, category, measure: the channels (x, y) that a sort by value is about: the first
    discrete one without an aggregate, and the first that is quantitative or aggregated. Charts
    without such a pair have no row."""
    e = encodings.where(F.col("channel").isin("x", "y") & F.col("column").isNotNull())
    added = F.coalesce(F.col("aggregate"), F.lit("")) != ""
    measure = added | F.col("type").eqNullSafe("quantitative")
    category = ~added & ~F.col("type").eqNullSafe("quantitative") & ~F.col("type").eqNullSafe("temporal")
    pair = e.groupBy("chart").agg(F.min(F.when(category, F.col("channel"))).alias("category"), F.min(F.when(measure, F.col("channel"))).alias("measure"))
    return pair.where("category is not null and measure is not null and category <> measure")


def overridden(encodings: DataFrame, overrides: DataFrame) -> DataFrame:
    """encodings with sort_by and sort_order as the layers of overrides leave them.

    overrides: chart, layer, value: value-asc, value-desc, or anything else for the default; a
    null value is no override. The encodings are the lowest layer; the highest layer with a value
    wins on the category channel, other channels keep theirs. Resolved by rank, so any
    number of layers is one aggregation."""
    top = overrides.where("value is not null").groupBy("chart").agg(F.max_by("value", "layer").alias("_wish"))
    plan = sort_channels(encodings).join(top, "chart")
    order = F.when(F.col("_wish") == "value-asc", "ascending").when(F.col("_wish") == "value-desc", "descending")
    wish = plan.select("chart", F.col("category").alias("channel"), F.lit(True).alias("_over"), F.when(order.isNotNull(), F.col("measure")).alias("_by"), order.alias("_order"))
    rows = encodings.join(wish, ["chart", "channel"], "left")
    over = F.coalesce("_over", F.lit(False))
    return rows.withColumns({"sort_by": F.when(over, F.col("_by")).otherwise(F.col("sort_by")), "sort_order": F.when(over, F.col("_order")).otherwise(F.col("sort_order"))}).select(*encodings.columns)


def shown_sort(encodings: DataFrame) -> DataFrame:
    """chart, shown: what a sort control shows: value-asc, value-desc, or null for the default
    and for orders that it doesn't know."""
    plan = sort_channels(encodings).withColumnRenamed("category", "channel")
    rows = plan.join(encodings.select("chart", "channel", "sort_by", "sort_order"), ["chart", "channel"])
    down = F.coalesce(F.col("sort_order") == "descending", F.lit(False))
    return rows.select("chart", F.when(F.col("sort_by") == F.col("measure"), F.when(down, "value-desc").otherwise("value-asc")).alias("shown"))


# Fixed values: (wish, order, whose, rule). Wishes: none, order (a direction alone), axis (x or
# y), colour, list, other; whose: own or other channel of an axis wish, there or absent for colour.
SORT_RULES = [
    ("none", None, "canonical", "list"), ("none", None, "number", "ascending"), ("none", None, "plain", "data"),
    ("order", "ascending", None, "ascending"), ("order", "descending", None, "descending"),
    ("axis", None, "own", "{}"), ("axis", "ascending", "own", "{}"), ("axis", "descending", "own", "-{}"),
    ("axis", None, "other", "-{}"), ("axis", "ascending", "other", "{}"), ("axis", "descending", "other", "-{}"),
    ("colour", None, "there", "-color"), ("colour", "ascending", "there", "color"), ("colour", "descending", "there", "-color"),
    ("colour", None, "absent", "data"), ("colour", "ascending", "absent", "data"), ("colour", "descending", "absent", "data"),
    ("list", None, None, "list"), ("list", "ascending", None, "list"), ("list", "descending", None, "list"),
    ("other", None, None, "data"), ("other", "ascending", None, "data"), ("other", "descending", None, "data"),
]


def sort_rules(spark: SparkSession, encodings: DataFrame) -> DataFrame:
    """encodings with rule and values: how the categories of each channel are ordered, by a join
    with SORT_RULES.

    encodings: chart, channel, column, type, sort_by, sort_order, numeric (its values are
    numbers), canonical (array: the order of its semantic type). rule is data (as they arrive),
    ascending or descending (by themselves), x, -x, y, -y, color, -color (by that channel's
    value, - for falling) or list (values). A list is a JSON array in sort_by, turned round if it
    falls; temporal channels and other texts keep the data's order."""
    rules = spark.createDataFrame(SORT_RULES, "_wish string, _order string, _whose string, _rule string")
    colour = F.max((F.col("channel") == "color") & F.col("column").isNotNull()).over(Window.partitionBy("chart"))
    by, order = F.nullif(F.col("sort_by"), F.lit("")), F.when(F.col("sort_order").isin("ascending", "descending"), F.col("sort_order"))
    listed = F.from_json(by, "array<string>")
    plain = F.try_parse_json(by).isNotNull() & by.rlike(r"^\s*\[")
    wish = (
        F.when(by.isNull(), F.when(order.isNull(), "none").otherwise("order")).when(by.isin("x", "y"), "axis").when(by == "color", "colour")
        .when((F.col("type") != "temporal") & F.coalesce(plain, F.lit(False)), "list").otherwise("other")
    )
    discrete = F.col("type").isin(*DISCRETE)
    whose = (
        F.when(F.col("_w") == "none", F.when(discrete & (F.size("canonical") > 0), "canonical").when(discrete & F.col("numeric"), "number").otherwise("plain"))
        .when(F.col("_w") == "axis", F.when(by == F.col("channel"), "own").otherwise("other"))
        .when(F.col("_w") == "colour", F.when(F.col("_c"), "there").otherwise("absent"))
    )
    rows = encodings.withColumns({"_w": wish, "_c": colour}).withColumns({"_o": F.when(F.col("_w") != "none", order), "_s": whose})
    found = rows.join(F.broadcast(rules), (F.col("_w") == F.col("_wish")) & F.col("_o").eqNullSafe(F.col("_order")) & F.col("_s").eqNullSafe(F.col("_whose")), "left")
    values = F.when(F.col("_rule") == "list", F.when(F.col("_w") == "none", F.col("canonical")).when(order == "descending", F.reverse(listed)).otherwise(listed))
    return found.select(*encodings.columns, F.replace("_rule", F.lit("{}"), by).alias("_axis"), "_rule", values.alias("values")).select(*encodings.columns, F.coalesce("_axis", "_rule").alias("rule"), "values")


def colour_segments(df: DataFrame, series: list[str], x: str, y: str, colour: str, tie: str) -> DataFrame:
    """series, no, x0, y0, x1, y1, colour: a line cut into pieces between neighbouring points, each
    with the colour of its first point; a continuous colour can't be drawn along one line.

    Points without x or y are left out, as a line skips them; tie orders points of equal x; a
    series of one point has no piece."""
    w = Window.partitionBy(*series).orderBy(x, tie)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ahead = rows.select(*series, F.row_number().over(w).alias("no"), F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"), F.col(colour).alias("colour"))
    return ahead.where("x1 is not null")


def continuous_colour(encodings: DataFrame) -> DataFrame:
    """chart, layered: whether the chart's line must be a neutral line under coloured points."""
    held = F.max((F.col("channel") == "color") & F.col("column").isNotNull() & F.col("type").isin(*CONTINUOUS))
    return encodings.groupBy("chart").agg(F.coalesce(held, F.lit(False)).alias("layered"))


def _in_box(lon: Column, lat: Column) -> Column:
    return lon.between(*US_LON) & lat.between(*US_LAT)


def map_scopes(points: DataFrame, by: list[str], lon: str | None = None, lat: str | None = None, place_id: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """by, scope, matched, n: us or world, from the data.

    Points: world if one with both coordinates lies outside the box of the States. Places: world
    if one isn't a known place id of the States (known: place_id); matched counts those that are.
    Rows without coordinates or place don't count; without any the scope is us."""
    if lon and lat:
        a, b = (_finite(c) for c in (lon, lat))
        return points.withColumns({"_a": a, "_b": b}).groupBy(*by).agg(F.count_if(_in_box(F.col("_a"), F.col("_b"))).alias("matched"), F.count(F.col("_a") + F.col("_b")).alias("n")).select(*by, F.when(F.col("matched") < F.col("n"), "world").otherwise("us").alias("scope"), "matched", "n")
    named = points.where(F.col(place_id).isNotNull() & (F.col(place_id).cast("string") != ""))
    hit = named.join(known.select(F.col("place_id").alias(place_id), F.lit(1).alias("_hit")).distinct(), place_id, "left")
    counts = hit.groupBy(*by).agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("n"))
    every = points.select(*by).distinct().join(counts, by, "left").select(*by, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("matched", "n")])
    return every.select(*by, F.when(F.col("matched") < F.col("n"), "world").otherwise("us").alias("scope"), "matched", "n")


def picked_scope(choice: Column, semantic: Column, inferred: Column) -> Column:
    """The region asked for, else that of the semantic type, else what the data say."""
    typed = F.try_element_at(F.create_map(*[F.lit(x) for kv in SEMANTIC_SCOPE.items() for x in kv]), F.coalesce(semantic, F.lit("")))
    return F.coalesce(F.when(choice.isin("us", "world"), choice), typed, inferred)


def point_encodings(layer: DataFrame, resolved: DataFrame) -> DataFrame:
    """chart, channel, settings (a map) of a map's point layer: resolved settings over the
    layer's own, key by key; channels without settings are left out."""
    both = layer.select("chart", "channel", F.col("settings").alias("_own")).join(resolved.select("chart", "channel", F.col("settings").alias("_new")), ["chart", "channel"], "full_outer")
    none = F.create_map().cast("map<string,string>")
    own, new = F.coalesce("_own", none), F.coalesce("_new", none)
    kept = F.map_filter(own, lambda k, v: ~F.map_contains_key(new, k))
    return both.select("chart", "channel", F.map_concat(kept, new).alias("settings")).where(F.size("settings") > 0)
