"""Generation planning: budgeted gate cascade and its accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import settle

MAX_COMPONENTS = 100_000


def _guarded(df: DataFrame) -> DataFrame:
    """A broadcast hint for a small table, after counting it."""
    return F.broadcast(df) if df.limit(MAX_COMPONENTS + 1).count() <= MAX_COMPONENTS else df


def gate_cascade(attempts: DataFrame, gates: list[tuple[str, Column, Column]], order: str = "ord") -> DataFrame:
    """attempts (component, ord, …) with reject_reason: the first gate that rejects it, null where it is accepted.

    gates: (name, fails, budget) in order. A gate rejects failing attempts that reached it, in order, until it has
    rejected `budget` of its component (the greatest of its rows); from then on it lets all pass. All tests are evaluated
    once, into a bit mask. Each gate then only needs to know at which attempt its budget ended, one number a component:
    a rank limit (partial before the shuffle) over the narrow masks finds it, and the ends found so far, one row a
    component, are what the next gate is met with, so the plan does not grow with the number of gates and attempts are
    never gathered by component. A null component is one of its own; a test that is null does not fail.
    """
    columns = attempts.columns
    bits = sum((F.when(F.coalesce(fails, F.lit(False)), F.lit(1 << i)).otherwise(0) for i, (_, fails, _) in enumerate(gates)), F.lit(0)).cast("long")
    masked = attempts.withColumn("_mask", bits)
    narrow = settle(masked.select("component", F.col(order).alias("_ord"), "_mask", *[b.cast("long").alias(f"_b{i}") for i, (_, _, b) in enumerate(gates)]), "gates")
    kind = narrow.schema["_ord"].dataType.simpleString()
    budgets = F.array(*[F.coalesce(F.max(f"_b{i}"), F.lit(0)) for i in range(len(gates))]) if gates else F.array().cast("array<bigint>")
    ends = settle(narrow.groupBy(F.col("component").alias("_c")).agg(budgets.alias("_budgets")).withColumn("_lasts", F.array().cast(f"array<{kind}>")), "ends")
    most = [m or 0 for m in ends.agg(*[F.max(F.col("_budgets")[i]) for i in range(len(gates))]).first()] if gates else []

    def hit(i: int) -> Column:
        return (F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0) & F.coalesce(F.col("_ord") <= F.col("_lasts")[i], F.lit(False))

    for i in range(len(gates)):
        live = narrow.select("component", "_ord", "_mask").join(_guarded(ends), F.col("component").eqNullSafe(F.col("_c")))
        for j in range(i):
            live = live.where(~hit(j))
        failing = live.where(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0).select("_c", "_ord", F.col("_budgets")[i].alias("_budget"))
        place = F.row_number().over(Window.partitionBy("_c").orderBy("_ord"))
        last = failing.withColumn("_place", place).where(F.col("_place") <= most[i]).where("_place <= _budget").groupBy(F.col("_c").alias("_d")).agg(F.max("_ord").alias("_last"))
        ends = settle(ends.join(last, F.col("_c").eqNullSafe(F.col("_d")), "left").select("_c", "_budgets", F.concat("_lasts", F.array("_last")).alias("_lasts")), "ends")
    done = masked.withColumn("_ord", F.col(order)).join(_guarded(ends), F.col("component").eqNullSafe(F.col("_c")), "left")
    reason = F.coalesce(*[F.when(hit(i), F.lit(name)) for i, (name, _, _) in enumerate(gates)], F.lit(None).cast("string"))
    return done.withColumn("reject_reason", reason).select(*columns, "reject_reason")


def attempt_stats(cascade: DataFrame, names: list[str], budget: Column) -> DataFrame:
    """(component, attempts, accepted, n_<gate>…, exhausted): rejections of each gate and the gates whose budget is used up."""
    per = [F.count_if(F.col("reject_reason") == n).alias(f"n_{n}") for n in names]
    stats = cascade.groupBy("component").agg(F.count("*").alias("attempts"), F.count_if(F.col("reject_reason").isNull()).alias("accepted"), *per)
    used = F.array_compact(F.array(*[F.when((F.col(f"n_{n}") >= budget) & (budget > 0), F.lit(n)) for n in names]))
    return stats.withColumn("exhausted", F.array_join(used, ","))


def generation_stats(attempts: DataFrame, names: list[str], budgets: DataFrame) -> DataFrame:
    """(component, attempts, generated, parse_failures, salvaged, duplicates, n_<gate>…, arabic_share, exhausted) of attempts
    (component, outcome, reject_reason, salvaged, arabic_script).

    outcome is parse_failure, duplicate, rejected or accepted; budgets (component, gate, budget) say how often a gate may
    reject: one that has used a budget above 0 up is exhausted, in the order of names. The share of Arabic rows is of the
    accepted ones, null without any. A null component is one of its own.
    """
    per = [F.count_if((F.col("outcome") == "rejected") & (F.col("reject_reason") == n)).alias(f"n_{n}") for n in names]
    accepted = F.col("outcome") == "accepted"
    stats = attempts.groupBy("component").agg(
        F.count("*").alias("attempts"), F.count_if(accepted).alias("generated"), F.count_if(F.col("outcome") == "parse_failure").alias("parse_failures"), F.count_if(F.coalesce("salvaged", F.lit(False))).alias("salvaged"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicates"), *per, F.round(F.avg(F.when(accepted, F.coalesce("arabic_script", F.lit(False)).cast("int"))), 6).alias("arabic_share"),
    )
    limits = budgets.groupBy(F.col("component").alias("_c")).agg(*[F.max(F.when(F.col("gate") == n, F.col("budget"))).alias(f"_b_{n}") for n in names])
    met = stats.join(_guarded(limits), F.col("component").eqNullSafe(F.col("_c")), "left")
    used = F.array_compact(F.array(*[F.when((F.col(f"_b_{n}") > 0) & (F.col(f"n_{n}") >= F.col(f"_b_{n}")), F.lit(n)) for n in names]))
    return met.withColumn("exhausted", F.array_join(used, ",")).drop("_c", *[f"_b_{n}" for n in names])
