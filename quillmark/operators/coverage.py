"""Coverage and recall: names, aliases and sources against what was collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import compact_key
from quillmark.functions.urls import coverage_key


def name_keys(name: Column, aliases: Column) -> Column:
    """Distinct normalised keys of a name and its aliases, without empty ones."""
    keys = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), compact_key)
    return F.filter(F.array_distinct(keys), lambda k: k != "")


def recall(truth: DataFrame, found: DataFrame) -> dict[str, DataFrame]:
    """hit and missed rows of truth, extra names of found, and the one-row ratio.

    Both need name and aliases. Keys are exploded and met in an equi-join, so neither side is
    compared pair by pair; a found name is extra once per normalised name."""
    t = truth.withColumns({"_id": F.monotonically_increasing_id(), "_keys": name_keys(F.col("name"), F.col("aliases"))})
    f = found.withColumn("_keys", name_keys(F.col("name"), F.col("aliases")))
    have = f.select(F.explode("_keys").alias("key")).distinct()
    known = t.select(F.explode("_keys").alias("key")).distinct()
    tk = t.withColumn("key", F.explode_outer("_keys"))
    scored = tk.join(have.withColumn("_hit", F.lit(1)), "key", "left").groupBy(*[c for c in t.columns if c != "_keys"]).agg(F.coalesce(F.max("_hit"), F.lit(0)).alias("_hit"))
    fk = f.withColumns({"_name": compact_key(F.col("name")), "key": F.explode_outer("_keys")}).join(known.withColumn("_hit", F.lit(1)), "key", "left")
    # a name that no truth has, and none of its aliases
    extra = fk.groupBy("_name", "name").agg(F.max("_hit").alias("_hit")).where("_hit is null").groupBy("_name").agg(F.min("name").alias("name")).select("name")
    total = scored.agg(F.coalesce(F.sum("_hit"), F.lit(0)).alias("found"), F.count(F.lit(1)).alias("total"))
    return {
        "hit": scored.where("_hit = 1").drop("_hit", "_id"),
        "missed": scored.where("_hit = 0").drop("_hit", "_id"),
        "extra": extra,
        "recall": total.select("found", "total", F.round(F.try_divide("found", "total"), 4).alias("ratio")),
    }


def facts_per_target(targets: DataFrame, facts: DataFrame, pieces: str = r"[,，、;/·&]| and ") -> DataFrame:
    """target, facts: facts whose entity, or a piece of it, is the target's name or alias."""
    t = targets.select(F.col("name").alias("target"), F.explode(name_keys(F.col("name"), F.col("aliases"))).alias("key"))
    parts = F.array_distinct(F.transform(F.concat(F.array("entity"), F.split("entity", pieces)), compact_key))
    f = facts.select(F.col("id").alias("_fact"), F.explode(parts).alias("key")).where("key <> ''")
    hits = t.join(f, "key").select("target", "_fact").distinct().groupBy("target").agg(F.count(F.lit(1)).alias("facts"))
    return targets.select(F.col("name").alias("target")).join(hits, "target", "left").select("target", F.coalesce("facts", F.lit(0)).alias("facts"))


def thin_targets(counts: DataFrame) -> DataFrame:
    return counts.where("facts <= 1")


def sources_outside_log(evidence: DataFrame, log: DataFrame, url: str = "source_url", log_url: str = "url", exempt: tuple[str, ...] = ("api_response", "negative_search", "calculation")) -> DataFrame:
    """One row: evidence_urls, missing_urls, missing_ratio: addresses of evidence that the fetch
    log doesn't have, types that need no fetch left out."""
    e = evidence.where(~F.coalesce(F.col("type").isin(*exempt), F.lit(False)) & (F.length(F.trim(url)) > 0)).select(coverage_key(F.col(url)).alias("key"))
    logged = log.select(coverage_key(F.col(log_url)).alias("key"), F.lit(1).alias("_in")).distinct()
    out = e.join(logged, "key", "left").agg(F.count(F.lit(1)).alias("evidence_urls"), F.count_if(F.col("_in").isNull()).alias("missing_urls"))
    return out.withColumn("missing_ratio", F.round(F.try_divide("missing_urls", "evidence_urls"), 4))


def coverage_counts(df: DataFrame, by: str, state: str, states: list[str]) -> DataFrame:
    """by, one count per state, total; and the row of all (null by)."""
    return df.rollup(by).agg(*[F.count_if(F.col(state) == s).alias(s) for s in states], F.count(F.lit(1)).alias("total"))


def duplicate_leads(leads: DataFrame, *fingerprints: str) -> DataFrame:
    """kind, fingerprint, n for fingerprints that several leads share."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("fingerprint")) for c in fingerprints])).alias("p")
    return leads.select(pairs).select("p.kind", "p.fingerprint").where("fingerprint is not null").groupBy("kind", "fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def convergence(workers: DataFrame, wave: str) -> DataFrame:
    """wave, eligible, excluded, leads, open_gaps, empty: no eligible worker of the wave found a
    new lead. workers: state, leads, gaps."""
    ok = F.col("state") == "ok"
    return workers.groupBy(wave).agg(
        F.count_if(ok).alias("eligible"), F.count_if(~ok).alias("excluded"), F.coalesce(F.sum(F.when(ok, F.col("leads"))), F.lit(0)).alias("leads"),
        F.coalesce(F.sum(F.when(ok, F.col("gaps"))), F.lit(0)).alias("open_gaps"), F.coalesce(F.bool_and(F.when(ok, F.col("leads") == 0)), F.lit(False)).alias("empty"),
    )


def worker_verdict(errors: Column, blocked: Column) -> Column:
    return F.when(errors > 0, "invalid").when(blocked > 0, "blocked").otherwise("ok")


def subject_counts(rows: DataFrame, name: Column, line: str) -> DataFrame:
    """name, n in order of first appearance."""
    return rows.withColumn("name", name).where(F.length("name") > 0).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(line).alias("first")).orderBy("first")


def subject(context_entity: Column, legacy: Column) -> Column:
    blank = lambda c: F.when(F.length(F.trim(c)) > 0, F.trim(c))
    return F.coalesce(blank(context_entity), blank(legacy))


def axes_without_quote(axes: DataFrame, facts: DataFrame, passed: DataFrame) -> DataFrame:
    """Axes with no confirmed fact that has a passed quote. passed: fact_id."""
    good = facts.where("status = 'confirmed'").join(passed.select(F.col("fact_id").alias("id")).distinct(), "id", "left_semi").select("axis").distinct()
    return axes.join(good, "axis", "left_anti")
