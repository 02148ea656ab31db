"""Receipts of gates: latest, order, prerequisites, currency of what they refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.logs import latest



def latest_receipts(receipts: DataFrame, gate: str = "gate", seq: str = "seq") -> DataFrame:
    return latest(receipts, [gate], seq)


def completed(receipts: DataFrame, gate: str = "gate", seq: str = "seq", exit_code: str = "exit") -> DataFrame:
    """Gates whose last receipt is a success, in the order of those receipts."""
    rows = receipts.withColumn("_seq", F.col(seq))
    return latest(rows, [gate], "_seq").where(F.col(exit_code) == 0).orderBy("_seq").drop("_seq")


def supersedes(receipts: DataFrame, gate: str, receipt: str, *order: str) -> DataFrame:
    """receipts with the id of the one before of the same gate."""
    return receipts.withColumn("supersedes", F.lag(receipt).over(Window.partitionBy(gate).orderBy(*order)))


def reference_states(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (receipt_id, path, sha256) with state: current, changed, missing, or appeared for
    a file recorded as missing that is there now."""
    f = files.select("path", F.col("sha256").alias("_now"))
    recorded_missing = F.lower("sha256") == "missing"
    state = (
        F.when(recorded_missing, F.when(F.col("_now").isNull(), "current").otherwise("appeared"))
        .when(F.col("_now").isNull(), "missing")
        .when(F.lower("sha256") == F.lower("_now"), "current")
        .otherwise("changed")
    )
    return refs.join(f, "path", "left").select(*refs.columns, state.alias("state"))


def receipt_issues(receipts: DataFrame, states: DataFrame, order: list[str], revision: str | None = None, plan_sha: str | None = None) -> DataFrame:
    """The latest receipt of each gate with issues (array of codes) and ok.

    receipts: gate, seq, receipt_id, exit, revision_id, research_plan_sha256 and
    prerequisite_receipts (gate -> receipt id). states: reference_states of all. order: gates
    from the first to the last; a prerequisite's own issues pass on down the line."""
    last = latest_receipts(receipts)
    bad_refs = states.where("state <> 'current'").groupBy("receipt_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("ref_"), F.col("state")))).alias("_refs"))
    ids = last.select(F.col("gate").alias("need"), F.col("receipt_id").alias("_now"))
    needs = last.select("gate", F.explode_outer("prerequisite_receipts").alias("need", "_had")).where("need is not null")
    stale = needs.join(ids, "need", "left").where(~F.col("_now").eqNullSafe(F.col("_had"))).groupBy("gate").agg(F.sort_array(F.collect_set(F.concat(F.lit("prerequisite_"), F.col("need")))).alias("_stale"))
    none = F.array().cast("array<string>")
    own = F.array_compact(
        F.array(
            F.when(F.col("exit") != 0, "failed"),
            F.when(~F.col("revision_id").eqNullSafe(F.lit(revision)), "revision") if revision else F.lit(None).cast("string"),
            F.when(~F.col("research_plan_sha256").eqNullSafe(F.lit(plan_sha)), "plan") if plan_sha else F.lit(None).cast("string"),
        )
    )
    out = last.join(bad_refs, "receipt_id", "left").join(stale, "gate", "left")
    out = out.withColumn("issues", F.concat(own, F.coalesce("_refs", none), F.coalesce("_stale", none))).drop("_refs", "_stale")
    needed = needs.groupBy("gate").agg(F.sort_array(F.collect_set("need")).alias("_needs"))
    out = out.join(needed, "gate", "left").withColumn("_needs", F.coalesce("_needs", none))
    # gates are few and fixed, so one row holds what each needs, and a fold over their line finds
    # all that stand below a broken one
    own_broken = F.collect_list(F.when(F.size("issues") > 0, F.col("gate")))
    by_gate = F.map_from_entries(F.collect_list(F.struct("gate", "_needs")))
    line = F.array(*map(F.lit, order)) if order else none
    pass_on = lambda broken, gate: F.when(F.arrays_overlap(F.coalesce(F.try_element_at(F.col("_all"), gate), none), broken), F.array_union(broken, F.array(gate))).otherwise(broken)
    broken = out.agg(own_broken.alias("_own"), by_gate.alias("_all")).select(F.aggregate(line, F.col("_own"), pass_on).alias("_broken"))
    out = out.crossJoin(F.broadcast(broken))  # one row
    below = F.transform(F.array_intersect("_needs", "_broken"), lambda g: F.concat(F.lit("below_"), g))
    out = out.withColumn("issues", F.array_union("issues", below)).drop("_needs", "_broken")
    return out.withColumn("ok", F.size("issues") == 0)


def record(receipts: DataFrame, rows: DataFrame, script_owned: tuple[str, ...] = (), manual: tuple[str, ...] = ()) -> DataFrame:
    """receipts with rows appended. A success of a script-owned gate can't be recorded this way,
    and a manual gate's receipt needs evidence."""
    bad = (F.col("gate").isin(*script_owned) & (F.col("exit") == 0)) if script_owned else F.lit(False)
    empty = (F.col("gate").isin(*manual) & (F.coalesce(F.trim("evidence"), F.lit("")) == "")) if manual else F.lit(False)
    ok = F.when(bad, F.raise_error(F.lit("this gate's success is recorded by its own program")).cast("boolean")).when(empty, F.raise_error(F.lit("a manual receipt needs evidence")).cast("boolean")).otherwise(F.lit(True))
    return receipts.unionByName(rows.where(ok), allowMissingColumns=True)
