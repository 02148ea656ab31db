"""Validation as columns: a schema becomes one projection that lists what each row violates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import iso_time

_KIND = {"string": "STRING", "integer": "BIGINT", "number": "(?:BIGINT|DOUBLE|DECIMAL.*)", "boolean": "BOOLEAN", "object": "(?:OBJECT|STRUCT|MAP).*", "array": "ARRAY.*", "null": "VOID"}


def _once(value: Column, use) -> Column:
    """use(value), with the value worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def field_rules(raw: Column, parsed: Column, name: str, spec: dict, enums: dict[str, list[str]], required: bool = False) -> Column:
    """Array of the rules of one field of a JSON object, read from its raw text and the variant
    parsed from it: a parsed struct would have turned a wrong type into null. Each is a code, or
    null where it is kept.

    spec: type (one or several), enum_ref or enum, pattern, format (iso-time, date-time,
    decimal), minLength, minItems, allowEmpty, properties, required, additionalProperties."""
    at = F.try_variant_get(parsed, f"$.{name}", "variant")
    seen = lambda value: F.struct(value.alias("value"), F.schema_of_variant(value).alias("kind"), F.try_variant_get(value, "$", "string").alias("text"))
    return _once(at, lambda value: _once(seen(value), lambda x: _of_field(raw, parsed, x, name, spec, enums, required)))


def _of_field(raw: Column, parsed: Column, x: Column, name: str, spec: dict, enums: dict[str, list[str]], required: bool) -> Column:
    value, kind, text = x["value"], x["kind"], x["text"]
    there = value.isNotNull() & (kind != "VOID")
    say = lambda rule, bad: F.when(there & F.coalesce(bad, F.lit(False)), F.lit(f"{name}: {rule}"))
    out = []
    if required:
        blank = ~there | ((kind == "STRING") & (text == "")) | (kind == "ARRAY<VOID>")
        out.append(F.when(F.coalesce(blank, F.lit(True)), F.lit(f"{name}: required")))
    types = spec.get("type", "object" if "properties" in spec else [])
    types = [types] if isinstance(types, str) else types
    if types:
        out.append(say("type", ~kind.rlike(f"^(?:{'|'.join(_KIND[t] for t in types)})$")))
        if "null" not in types:
            out.append(F.when(kind == "VOID", F.lit(f"{name}: type")))
    if "string" in types:
        is_text = kind == "STRING"
        if not spec.get("allowEmpty"):
            out.append(say("blank", is_text & (F.length(F.trim(text)) == 0)))
        if spec.get("minLength"):
            out.append(say("length", is_text & (F.length(text) < spec["minLength"])))
    allowed = spec.get("enum") or enums.get(spec.get("enum_ref", ""))
    if allowed:
        out.append(say("enum", ~text.isin(*[str(x) for x in allowed])))
    if spec.get("pattern"):
        out.append(say("pattern", ~text.rlike(f"^(?:{spec['pattern']})$")))
    if spec.get("format") in ("iso-time", "date-time"):
        out.append(say("format", ~iso_time(text, timestamp=spec["format"] == "date-time")))
    if spec.get("format") == "decimal" or {"integer", "number"} & set(types):
        number = text.try_cast("double")
        out.append(say("finite", (spec.get("format") == "decimal") & (number.isNull() | F.isnan(number) | (F.abs(number) == float("inf")))))
    if spec.get("minItems"):
        n = F.size(F.try_variant_get(value, "$", "array<variant>"))
        out.append(say("items", n < spec["minItems"]))
    if spec.get("additionalProperties") is False:
        known = F.array(*[F.lit(k) for k in spec.get("properties", {})]) if spec.get("properties") else F.array().cast("array<string>")
        names = F.json_object_keys(F.get_json_object(raw, f"$.{name}"))
        out.append(say("unknown field", F.size(F.array_except(names, known)) > 0))
    none = F.array().cast("array<string>")
    nested = [F.when(there, field_rules(raw, parsed, f"{name}.{key}", inner, enums, key in spec.get("required", []))).otherwise(none) for key, inner in spec.get("properties", {}).items()]
    return F.concat(F.array(*out).cast("array<string>"), *nested)


def compile_rules(raw: Column, schema: dict, enums: dict[str, list[str]]) -> Column:
    """Array of violated rules of a JSON object in a text column."""
    return _once(F.try_parse_json(raw), lambda parsed: _of_object(raw, parsed, schema, enums))


def _of_object(raw: Column, parsed: Column, schema: dict, enums: dict[str, list[str]]) -> Column:
    fields = [field_rules(raw, parsed, name, spec, enums, name in schema.get("required", [])) for name, spec in schema.get("properties", {}).items()]
    rules = []
    if schema.get("additionalProperties") is False:
        known = F.array(*[F.lit(k) for k in schema.get("properties", {})])
        rules.append(F.when(F.size(F.array_except(F.json_object_keys(raw), known)) > 0, F.lit("unknown field")))
    rules.append(F.when(parsed.isNull(), F.lit("not json")))
    return F.array_compact(F.concat(*fields, F.array(*rules)))


def version_rules(raw: Column) -> Column:
    """schema_version: 3 if missing; 3 and 4 only; no key that looks like a misspelling."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(raw), "$.schema_version", "variant"))
    value = F.get_json_object(raw, "$.schema_version")
    odd = F.exists(F.json_object_keys(raw), lambda k: (k != "schema_version") & k.rlike(r"(?i)^schema[\W_]*ver"))
    return F.array_compact(F.array(F.when(odd, F.lit("schema_version: misspelt")), F.when((kind.isNotNull() & (kind != "BIGINT")) | ~F.coalesce(value, F.lit("3")).isin("3", "4"), F.lit("schema_version: unknown"))))


def fact_rules() -> Column:
    """Rules of a typed fact row beyond its schema: ids, and what a confirmed fact needs.
    Columns: id, status, evidence_ids, verify_events, counter_search, discard_reason, demoted_at."""
    confirmed = F.col("status") == "confirmed"
    lead = F.filter("verify_events", lambda e: (e["by"] == "lead") & (e["action"] == "reread"))
    hashed = F.exists(lead, lambda e: F.coalesce(e["reread_sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False)))
    last = F.array_max(F.transform(lead, lambda e: e["at"]))
    none = F.lit(False)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("id").rlike(r"^F\d{3,}$"), none), F.lit("id")),
            F.when(confirmed & (F.coalesce(F.size("evidence_ids"), F.lit(0)) < 1), F.lit("confirmed without evidence")),
            F.when(confirmed & ~F.coalesce(hashed, none), F.lit("confirmed without the lead's reread")),
            F.when(confirmed & F.coalesce(F.col("counter_search.found_stronger_refutation"), none), F.lit("confirmed against a stronger refutation")),
            F.when(confirmed & (F.length(F.coalesce("discard_reason", F.lit(""))) > 0), F.lit("confirmed with a discard reason")),
            F.when(confirmed & F.col("demoted_at").isNotNull() & ~F.coalesce(last > F.col("demoted_at"), none), F.lit("no reread after the demotion")),
        )
    )


def evidence_rules() -> Column:
    """Rules of a typed evidence row: ids, quotes, span order, capture. Columns: id, fact_id,
    type, verbatim, span, capture, capture_review, schema_version."""
    path = F.regexp_replace(F.regexp_replace(F.col("capture"), r"/\./", "/"), r"[^/]+/\.\./", "")
    review = F.col("capture_review")
    accepted = review["verdict"] == "accept"
    none = F.lit(False)
    return F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("id").rlike(r"^E\d{3,}$"), none), F.lit("id")),
            F.when(~F.coalesce(F.col("fact_id").rlike(r"^F\d{3,}$"), none), F.lit("fact_id")),
            F.when((F.col("type") == "text_quote") & (F.length(F.trim(F.coalesce("verbatim", F.lit("")))) == 0), F.lit("quote without text")),
            F.when(F.coalesce((F.col("span.line") < 1) | (F.col("span.end") < F.col("span.line")), none), F.lit("span order")),
            F.when(F.col("capture").isNotNull() & (~path.rlike(r"^(?:\./)?_captures/") | path.contains("_reconstructed") | path.contains("..")), F.lit("capture path")),
            F.when((F.coalesce("schema_version", F.lit(3)) == 4) & F.col("capture").isNotNull() & review.isNull(), F.lit("capture without review")),
            F.when(F.coalesce(accepted & ~(review["claim_visible"] & review["context_visible"] & (F.length(review["page_state"]) > 0)), none), F.lit("accepted without what it shows")),
        )
    )


def review_rules(columns: list[str], supports: list[str]) -> Column:
    """Rules of claim-review rows: known columns, non-empty texts, distinct ids, known support."""
    # The fields of a review row.
    fields = ["sentence_id", "claim_type", "fact_ids", "evidence_ids", "support", "unsupported_terms", "required_qualification", "sentence_text", "reviewed_text_sha256", "evidence_revision", "evidence_content_sha256", "schema_version"]
    unknown = [c for c in columns if c not in fields]
    distinct = lambda c: F.size(F.array_distinct(c)) != F.size(c)
    return F.array_compact(
        F.array(
            F.lit(f"unknown field {unknown[0]}") if unknown else F.lit(None).cast("string"),
            *[F.when(F.length(F.trim(F.coalesce(c, F.lit("")))) == 0, F.lit(f"{c}: empty")) for c in ("sentence_id", "sentence_text", "reviewed_text_sha256")],
            *[F.when(F.coalesce(distinct(c), F.lit(False)), F.lit(f"{c}: repeated")) for c in ("fact_ids", "evidence_ids")],
            F.when(~F.col("support").isin(*supports), F.lit("support: unknown")),
        )
    )


def violations(df: DataFrame, rules: Column, *keep: str) -> DataFrame:
    """keep, rule: one row for each violated rule."""
    return df.select(*keep, F.explode(rules).alias("rule"))


def require(df: DataFrame, rules: Column, strict: Column) -> DataFrame:
    """df with warnings; a strict row with a violation fails when it is read."""
    out = df.withColumn("warnings", rules)
    bad = strict & (F.size("warnings") > 0)
    ok = F.when(bad, F.raise_error(F.concat_ws("; ", "warnings")).cast("boolean")).otherwise(F.lit(True))
    return out.where(ok)
