"""What a column means: types from values and names, defaults for charts."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels with an order of their own.
ORDERS = {
    "month": ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"],
    "weekday": ["mon", "tue", "wed", "thu", "fri", "sat", "sun"],
    "quarter": ["q1", "q2", "q3", "q4"],
    "compass": ["n", "ne", "e", "se", "s", "sw", "w", "nw"],
}
# Semantic type -> family, how it adds up, domain.
TYPES = {
    "Quantity": ("measure", "additive", None), "Count": ("measure", "additive", None), "Amount": ("measure", "additive", None), "Price": ("measure", "intensive", None),
    "Percentage": ("measure", "intensive", (0.0, 100.0)), "Temperature": ("measure", "intensive", None), "Rank": ("ordinal", "none", None), "Score": ("measure", "intensive", None),
    "Correlation": ("measure", "intensive", (-1.0, 1.0)), "Latitude": ("geo", "none", (-90.0, 90.0)), "Longitude": ("geo", "none", (-180.0, 180.0)), "Country": ("geo", "none", None),
    "Region": ("geo", "none", None), "Year": ("temporal", "none", None), "Month": ("temporal", "none", None), "Date": ("temporal", "none", None), "DateTime": ("temporal", "none", None),
    "Category": ("categorical", "none", None), "Name": ("categorical", "none", None), "Boolean": ("categorical", "none", None), "Profit": ("measure", "signed-additive", None), "Delta": ("measure", "signed-additive", None),
}
UNKNOWN = ("categorical", "none", None)


def profile(df: DataFrame, *columns: str) -> list[dict]:
    """One dictionary per column from one aggregation over all of them: counts, extent, what the
    values look like."""
    columns = columns or tuple(df.columns)
    agg = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("string")
        n = v.try_cast("double")
        blank = v.isNull() | (v == "")
        agg += [
            F.count(F.lit(1)).alias(f"rows{i}"), F.count(v).alias(f"present{i}"), F.approx_count_distinct(v, 0.02).alias(f"distinct{i}"),
            F.coalesce(F.bool_and(blank | n.isNotNull() | v.isin("true", "false")), F.lit(True)).alias(f"numeric{i}"), F.coalesce(F.bool_and(blank | v.isin("true", "false")), F.lit(False)).alias(f"bool{i}"),
            F.coalesce(F.bool_and(blank | F.try_to_timestamp(v).isNotNull()), F.lit(False)).alias(f"dates{i}"), F.min(n).alias(f"min{i}"), F.max(n).alias(f"max{i}"),
            F.min(F.when(n > 0, n)).alias(f"positive{i}"), F.coalesce(F.bool_and(n.isNull() | (n == F.floor(n))), F.lit(False)).alias(f"whole{i}"), F.avg(F.when(F.abs(n) <= 1, 1.0).otherwise(0.0)).alias(f"small{i}"),
            F.least(F.lit(4), F.max(F.length(F.regexp_extract(v, r"\.(\d+)$", 1)))).alias(f"places{i}"),
        ]
    row = df.agg(*agg).first().asDict()
    return [{"column": c, **{k[: -len(str(i))]: x for k, x in row.items() if re.fullmatch(rf"[a-z]+{i}", k)}} for i, c in enumerate(columns)]


def visual_type(p: dict) -> str:
    if p["bool"] and p["present"]:
        return "nominal"
    if p["numeric"]:
        return "quantitative"
    return "temporal" if p["dates"] else "nominal"


def is_year(p: dict) -> bool:
    """The name has the word year and the values are several whole numbers of 1500 to 2200."""
    words = [w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", p["column"])]
    return "year" in words and bool(p["whole"]) and p["min"] is not None and 1500 <= p["min"] <= p["max"] <= 2200 and p["distinct"] > 1


def default_aggregate(semantic: str) -> str | None:
    role = TYPES.get(semantic, UNKNOWN)[1]
    return {"additive": "sum", "signed-additive": "sum", "intensive": "average"}.get(role)


def aggregated_name(column: str | None, aggregate: str) -> str:
    return "_count" if aggregate == "count" else f"{column}_{aggregate}"


def percent_scale(p: dict) -> str:
    """0-1 if four of five values are within one, else 0-100."""
    return "0-1" if (p["small"] or 0) >= 0.8 else "0-100"


def scale_type(p: dict) -> str:
    """log if ten values or more, none negative, span six decades; symlog with zeros."""
    if p["present"] < 10 or p["min"] is None or p["min"] < 0 or not p["positive"] or p["max"] / p["positive"] < 1e6:
        return "linear"
    return "symlog" if p["min"] == 0 else "log"


def domain(p: dict, semantic: str) -> tuple[float, float] | None:
    """Fixed ranges clamp; a percentage's bound is used if the data come within a quarter of
    it; other columns have the data's."""
    if p["min"] is None:
        return None
    fixed = TYPES.get(semantic, UNKNOWN)[2]
    if not fixed:
        return p["min"], p["max"]
    if semantic != "Percentage":
        return fixed
    lo, hi = (0.0, 1.0) if percent_scale(p) == "0-1" else fixed
    near = 0.25 * (hi - lo)
    return (lo if p["min"] - lo <= near else p["min"]), (hi if hi - p["max"] <= near else p["max"])


def ordinal_order(labels: list[str]) -> list[str] | None:
    """The known order of months, weekdays, quarters or compass points, if three of five labels
    and two at least belong to it; labels in that order, unknown ones last."""
    for name, order in ORDERS.items():
        key = lambda x, n=name: x.strip().lower()[: 3 if n in ("month", "weekday") else 2]
        known = [x for x in labels if key(x) in order]
        if len(known) >= 2 and len(known) >= 0.6 * len(labels):
            return sorted(labels, key=lambda x: order.index(key(x)) if key(x) in order else len(order))
    return None


def midpoint(p: dict, unit: str | None = None) -> float | None:
    """Where colours diverge: fixed for temperatures, zero where the sign changes."""
    fixed = {"°C": 0.0, "℃": 0.0, "°F": 32.0}
    if unit in fixed:
        return fixed[unit]
    return 0.0 if p["min"] is not None and p["min"] < 0 < p["max"] else None


def zero_baseline(p: dict, semantic: str, mark: str) -> bool:
    """Bars and areas start at zero; points do if the data come near it for an additive measure."""
    if mark in ("bar", "area"):
        return True
    role = TYPES.get(semantic, UNKNOWN)[1]
    return role == "additive" and p["min"] is not None and p["min"] >= 0 and p["min"] <= 0.25 * (p["max"] or 0)


def ticks(p: dict) -> list[int] | None:
    if not p["whole"] or p["min"] is None or p["max"] - p["min"] > 20:
        return None
    return list(range(int(p["min"]), int(p["max"]) + 1))


def discrete_type(p: dict) -> str:
    return "ordinal" if p["distinct"] <= 20 else "nominal"


def default_type(p: dict, semantic: str) -> str:
    family = TYPES.get(semantic, UNKNOWN)[0]
    if family == "temporal":
        return "ordinal" if p["distinct"] <= 6 else "temporal"
    if family == "measure" and p["numeric"]:
        return "quantitative"
    return "ordinal" if p["numeric"] and p["distinct"] <= 12 else "nominal"


def unit_semantic(unit: str | None) -> str:
    if unit and "%" in unit:
        return "Percentage"
    return "Count" if unit in {"건", "명", "개", "개사", "대", "기"} else "Quantity"


def channel_type(p: dict, semantic: str, channel: str) -> str:
    """Type on a channel: colours and groups with many numbers stay quantitative, few are
    discrete; a measure that isn't numeric falls back to what its values are."""
    t = default_type(p, semantic)
    if TYPES.get(semantic, UNKNOWN)[0] == "measure" and not p["numeric"]:
        return visual_type(p)
    if channel in ("color", "group") and t == "quantitative" and p["distinct"] <= 12 and p["whole"]:
        return "ordinal"
    return t


def field_semantics(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """column, semantic, type, aggregate, scale, lo, hi, distinct: one row per column."""
    rows = []
    for p in profile(df):
        semantic = (types or {}).get(p["column"]) or ("Year" if is_year(p) else {"quantitative": "Quantity", "temporal": "DateTime", "nominal": "Category"}[visual_type(p)])
        lo, hi = domain(p, semantic) or (None, None)
        rows.append((p["column"], semantic, default_type(p, semantic), default_aggregate(semantic), scale_type(p) if p["numeric"] else None, lo, hi, p["distinct"]))
    return df.sparkSession.createDataFrame(rows, "column string, semantic string, type string, aggregate string, scale string, lo double, hi double, distinct long")


def granularity(values: list[str]) -> str:
    """year, quarter, month, day, hour or second: the coarsest that tells the first 100 dates
    apart."""
    from datetime import datetime

    found = []
    for v in values[:100]:
        try:
            found.append(datetime.fromisoformat(v))
        except ValueError:
            continue
    if not found:
        return "unknown"
    n = len({*found})
    steps = {"year": lambda d: d.year, "quarter": lambda d: (d.year, (d.month - 1) // 3), "month": lambda d: (d.year, d.month), "day": lambda d: d.date(), "hour": lambda d: (d.date(), d.hour)}
    return next((k for k, f in steps.items() if len({f(d) for d in found}) == n), "second")


def two_digit_year(y: int) -> int:
    return y if y > 99 else 2000 + y if y <= 49 else 1900 + y


def epoch_unit(x: float) -> str | None:
    if not math.isfinite(x):
        return None
    return "s" if 1e9 <= x <= 4_102_444_800 else "ms" if 4_102_444_800 < x <= 4_102_444_800_000 else None
