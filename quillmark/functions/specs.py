"""Chart specifications and requests as rows: numbers and nulls of their JSON, channel shorthand,
fact lists, output places, names of work folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names can't hold, and the length of a name.
FORBIDDEN = r'[\\/:*?"<>|]'
NAME_LENGTH = 40

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
# a string as it is, or a whole number written with zeros after its point (of -0.0, without sign)
_WHOLE = rf"({_STRING})|(?<![\d.eE+-])(?:-(?=0+\.0+(?![\deE])))?+(-?\d{{1,32}})\.0+(?![\deE])"
# what that leaves: exponents, and more digits than a decimal(38,6) has
_ODD = r"\d[eE]|\.\d{7}"
_NUMBER = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"


def _woven(gaps: Column, between: Column) -> Column:
    """gaps[0] between[0] gaps[1] ... of two arrays, the first one longer by one."""
    return F.array_join(F.flatten(F.zip_with(gaps, between, lambda g, b: F.array(g, F.coalesce(b, F.lit(""))))), "")


def _whole(n: Column) -> Column:
    """A number's text, without point and exponent if its value is whole."""
    value = n.try_cast("decimal(38,6)")
    plain = F.regexp_replace(F.floor(value).cast("decimal(38,0)").cast("string"), "^-0$", "0")
    return F.when(n.rlike("[.eE]") & (value == F.floor(value)) & (n.try_cast("double") == value.cast("double")), plain).otherwise(n)


def spec_numbers(json: Column) -> Column:
    """A JSON text whose whole-valued numbers are written as integers (200.0 as 200, 1.5E3 as
    1500); what stands in strings isn't touched. Null stays null. Numbers beyond 38 digits stay."""
    plain = F.regexp_replace(json, _WHOLE, "$1$2")
    return F.when(json.rlike(_ODD), _by_value(json)).otherwise(plain)


def _by_value(json: Column) -> Column:
    """spec_numbers number by number."""
    outside = F.split(json, _STRING, -1)
    numbers = lambda part: _woven(F.split(part, _NUMBER, -1), F.transform(F.regexp_extract_all(part, F.lit(_NUMBER), F.lit(0)), _whole))
    return _woven(F.transform(outside, numbers), F.regexp_extract_all(json, F.lit(_STRING), F.lit(0)))


def spec(*fields: Column) -> Column:
    """JSON of a specification: fields without a value left out, also in nested structs, and
    numbers as in spec_numbers."""
    return spec_numbers(F.to_json(F.struct(*fields)))


def channel_settings(value: Column) -> Column:
    """A channel's JSON setting in full: a bare string names a field, also inside a list; anything
    else stays."""
    field = lambda v: F.to_json(F.struct(v.alias("field")))
    kind = F.schema_of_variant(F.try_parse_json(value))
    text = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    items = F.transform(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda v: F.to_json(v))
    each = lambda x: F.when(x.startswith('"'), field(F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"))).otherwise(x)
    return F.when(kind == "STRING", field(text)).when(kind.startswith("ARRAY"), F.concat(F.lit("["), F.array_join(F.transform(items, each), ","), F.lit("]"))).otherwise(value)


def fact_list(ids: Column) -> Column:
    """Fact ids of a comma list, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def argument_issues(ids: Column, target: Column) -> Column:
    """Array of what is wrong with a chart request: no facts, a fact twice, an output outside
    assets (relative paths lie in the work folder; .. is followed), another ending than .svg.
    A null target is the default one."""
    listed = fact_list(ids)
    # leading steps down and up cancel out, from the inside
    steps = F.filter(F.split(target, "/"), lambda s: (s != "") & (s != "."))
    resolved = F.aggregate(steps, F.array().cast("array<string>"), lambda at, s: F.when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))
    outside = target.startswith("/") | (F.size(resolved) < 2) | ~F.get(resolved, F.lit(0)).eqNullSafe(F.lit("assets"))
    # a path that leaves the work folder on its way isn't resolved against it
    depth = F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), lambda n: F.aggregate(F.slice(steps, F.lit(1), n), F.lit(0), lambda d, s: d + F.when(s == "..", -1).otherwise(1))))
    return F.array_compact(
        F.array(
            F.when(F.size(listed) == 0, "no facts"),
            F.when(F.size(F.array_distinct(listed)) < F.size(listed), "fact twice"),
            F.when(target.isNotNull() & (outside | (depth < 0)), "outside assets"),
            F.when(target.isNotNull() & ~F.lower(target).endswith(".svg"), "not svg"),
        )
    )


def slug(topic: Column, most: int = NAME_LENGTH) -> Column:
    """A topic as the name of a folder or file: characters that file names can't hold left out,
    white space as _, cut to `most` characters, without _ at its ends; `untitled` if nothing is
    left. Letters of any script stay."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(topic, r"^\s+|\s+$", ""), FORBIDDEN, ""), r"\s+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(name, 1, most), "^_+|_+$", ""), F.lit("")), F.lit("untitled"))


def work_folder(topic: Column, day: Column) -> Column:
    return F.concat(F.lit("research_"), slug(topic), F.lit("_"), F.date_format(day, "yyyyMMdd"))
