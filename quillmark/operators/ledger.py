"""The ledger of facts and evidence: integrity, keys, mutations, digests."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What a claim key is made of, old and new.
KEY_FIELDS = ("metric", "entity", "entity_id", "geography", "period", "basis", "scenario", "definition")
OLD_KEY_FIELDS = ("metric", "entity", "geography", "period", "basis", "scenario")


def claim_key(context: Column) -> Column:
    """v4: and the SHA-256 of the JSON array of the context's fields, null unlike ''."""
    return F.concat(F.lit("v4:"), F.sha2(F.to_json(F.array(*[context[f] for f in KEY_FIELDS])), 256))


def old_claim_key(context: Column) -> Column:
    norm = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "na").otherwise(F.replace(F.trim(c), F.lit("|"), F.lit("/")))
    return F.concat_ws("|", *[norm(context[f]) for f in OLD_KEY_FIELDS])


def version(column: Column) -> Column:
    """Schema version: 3 if it isn't given, null if it is neither 3 nor 4."""
    v = F.coalesce(column, F.lit(3))
    return F.when(v.isin(3, 4), v)


def next_id(df: DataFrame, id_col: str, prefix: str = "F") -> DataFrame:
    """One row: the prefix and the largest number so far plus one, three digits at least."""
    n = F.max(F.regexp_extract(id_col, rf"^{prefix}(\d{{3,}})$", 1).try_cast("bigint"))
    new = (F.coalesce(n, F.lit(0)) + 1).cast("string")
    return df.agg(F.concat(F.lit(prefix), F.when(F.length(new) >= 3, new).otherwise(F.lpad(new, 3, "0"))).alias("next_id"))


def reference_issues(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """issue, fact_id, evidence_id, strict: both directions of the fact-evidence references.

    facts: id, evidence_ids, schema_version; evidence: id, fact_id, schema_version.
    missing_evidence: a listed id doesn't exist; other_fact: it names another fact;
    not_listed: evidence whose fact doesn't exist or doesn't list it. strict if either row is
    of version 4. Each direction is one equi-join; neither side is collected."""
    f = facts.select(F.col("id").alias("fact_id"), "evidence_ids", F.coalesce("schema_version", F.lit(3)).alias("fv"))
    e = evidence.select(F.col("id").alias("evidence_id"), F.col("fact_id").alias("own_fact"), F.coalesce("schema_version", F.lit(3)).alias("ev"))
    listed = f.select("fact_id", "fv", F.explode("evidence_ids").alias("evidence_id"))
    strict = (F.coalesce("fv", F.lit(3)) == 4) | (F.coalesce("ev", F.lit(3)) == 4)
    forward = listed.join(e.withColumn("_e", F.lit(1)), "evidence_id", "left")
    forward = forward.where(F.col("_e").isNull() | ~F.col("own_fact").eqNullSafe(F.col("fact_id"))).select(
        F.when(F.col("_e").isNull(), "missing_evidence").otherwise("other_fact").alias("issue"), "fact_id", "evidence_id", strict.alias("strict")
    )
    back = e.join(listed.select("evidence_id", F.col("fact_id").alias("own_fact"), F.lit(1).alias("_l")).distinct(), ["evidence_id", "own_fact"], "left").where("_l is null")
    back = back.join(f.select(F.col("fact_id").alias("own_fact"), "fv"), "own_fact", "left")
    return forward.union(back.select(F.lit("not_listed").alias("issue"), F.col("own_fact").alias("fact_id"), "evidence_id", strict.alias("strict")))


def require_integrity(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The issues that only warn; fails if there is a strict one."""
    issues = reference_issues(facts, evidence)
    bad = issues.where("strict").limit(1).collect()
    if bad:
        raise ValueError(f"ledger reference broken: {bad[0].asDict()}")
    return issues.where("not strict")


def reject_orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose parent exists, the others)."""
    ids = parents.select(F.col(parent_key).alias(key))
    return rows.join(ids, key, "left_semi"), rows.join(ids, key, "left_anti")


def insert(ledger: DataFrame, rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(ledger with the rows that repeat none of its keys or of each other, rejected rows with
    a reason). Merging is for the caller to ask for."""
    found = rows
    for k in keys:
        there = ledger.select(F.col(k), F.lit(True).alias(f"_in_{k}")).distinct()
        n = rows.groupBy(k).agg((F.count(F.lit(1)) > 1).alias(f"_twice_{k}"))
        found = found.join(there, k, "left").join(n, k, "left")
    reason = F.concat_ws(", ", *[x for k in keys for x in (F.when(F.col(f"_in_{k}"), F.lit(f"{k} exists")), F.when(F.col(f"_twice_{k}"), F.lit(f"{k} repeated")))])
    found = found.withColumn("reason", reason)
    return ledger.unionByName(found.where("reason = ''").select(*rows.columns), allowMissingColumns=True), found.where("reason <> ''").select(*rows.columns, "reason")


def lead_rereads(events: Column) -> Column:
    """Events in which the lead read the source again, with a hash of what was read."""
    return F.filter(events, lambda e: (e["by"] == "lead") & (e["action"] == "reread"))


def append_event(facts: DataFrame, events: DataFrame, fact_id: str = "id") -> DataFrame:
    """facts with the events (fact_id, event struct) appended in order of their time. A lead's
    reread needs a SHA-256 and fails without one."""
    event = F.col("event")
    bad = (event["by"] == "lead") & (event["action"] == "reread") & ~F.coalesce(event["reread_sha256"].rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    checked = events.withColumn("event", F.when(bad, F.raise_error(F.lit("a lead's reread needs a sha256")).cast(events.schema["event"].dataType)).otherwise(event))
    more = checked.groupBy("fact_id").agg(F.array_sort(F.collect_list("event"), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("_more"))
    out = facts.join(more.withColumnRenamed("fact_id", fact_id), fact_id, "left")
    empty = F.array().cast(facts.schema["verify_events"].dataType)
    return out.withColumn("verify_events", F.concat(F.coalesce("verify_events", empty), F.coalesce("_more", empty))).drop("_more")


def set_status(facts: DataFrame, changes: DataFrame, at: str) -> DataFrame:
    """facts with changes (id, new_status, reason) made: leaving confirmed stamps demoted_at,
    discarding stores the reason, anything else clears it."""
    out = facts.join(changes.select("id", "new_status", "reason"), "id", "left")
    new = F.coalesce("new_status", "status")
    demoted = F.when((F.col("status") == "confirmed") & (new != "confirmed"), F.lit(at)).otherwise(F.col("demoted_at"))
    reason = F.when(F.col("new_status").isNull(), F.col("discard_reason")).when(new == "discarded", F.col("reason"))
    return out.withColumns({"demoted_at": demoted, "discard_reason": reason, "status": new}).drop("new_status", "reason")


def _components(batches):
    """(key, number of connected observations) of rows (key, values) that come key by key: a
    union-find over values, linear in a fact's distinct observations."""
    now, root, bare, out = None, {}, False, []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def count() -> int:
        return sum(find(x) == x for x in root) + bare

    for batch in batches:
        for key, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (key,) != now:
                if now is not None:
                    out.append((now[0], count()))
                now, root, bare = (key,), {}, False
            if not values:
                bare = True
            for v in values:
                root.setdefault(v, v)
                root[find(v)] = find(values[0])
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([n for _, n in out], pa.int32())], ["key", "observers"])
            out = []
    if now is not None:
        out.append((now[0], count()))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], batch.schema.field(0).type), pa.array([n for _, n in out], pa.int32())], ["key", "observers"])


def observers(observations: DataFrame, by: str, keys: list[str]) -> DataFrame:
    """by, observers: how many independent observers a fact has. Observations that share a
    group, an address or a hash, directly or over others, are one; those without any are one
    together. Equal observations are merged before the shuffle; a fact's others meet in one
    task, which holds their values and takes linear time."""
    values = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), F.col(k)) for k in keys]))
    rows = observations.select(F.col(by).alias("key"), values.alias("values")).distinct()
    out = rows.repartition("key").sortWithinPartitions("key").mapInArrow(_components, T.StructType([rows.schema["key"], T.StructField("observers", T.IntegerType())]))
    return out.withColumnRenamed("key", by)


def union_kinds(*frames: DataFrame) -> DataFrame:
    """Rows of several kinds in one table, columns by name, null where a kind has none."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
