"""Quality checks and run history: agreement, windows, tickets, rates, reconciliation, retention, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cohen_kappa(pairs: DataFrame, expected: str = "expected", predicted: str = "predicted") -> DataFrame:
    """One row ``(n, agreement, kappa)`` from the confusion counts of two label columns."""
    counts = pairs.groupBy(expected, predicted).agg(F.count("*").alias("n"))
    a = counts.groupBy(F.col(expected).alias("label")).agg(F.sum("n").alias("na"))
    b = counts.groupBy(F.col(predicted).alias("label")).agg(F.sum("n").alias("nb"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("ab"))
    same = counts.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col(expected) == F.col(predicted), F.col("n"))), F.lit(0)).alias("hit"))
    one = same.crossJoin(chance)  # one row each
    po, pe = F.col("hit") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    return one.select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0).alias("kappa"))


def agreement_scores(expected: DataFrame, predicted: DataFrame, flag_types: list[str], customers: DataFrame) -> DataFrame:
    """Kappa of the indicator table customer x flag type; the types are a fixed list."""
    types = F.explode(F.array(*map(F.lit, flag_types))).alias("flag_type")
    grid = customers.select("customer_id", types)
    mark = lambda df, n: df.select("customer_id", "flag_type", F.lit(1).alias(n)).distinct()
    j = grid.join(mark(expected, "expected"), ["customer_id", "flag_type"], "left").join(mark(predicted, "predicted"), ["customer_id", "flag_type"], "left")
    return cohen_kappa(j.fillna(0, ["expected", "predicted"]))


def window_checks(threads: DataFrame, accounts: DataFrame, ref: str, final_days: int = 30) -> DataFrame:
    """``(check, n)``: threads outside the owner's window, early cancellations, later dates, unknown customers."""
    j = threads.join(accounts, "customer_id", "left")
    day = F.to_date("created_at")
    known = F.col("observation_start").isNotNull()
    one = j.agg(
        F.sum((known & ((day < F.col("observation_start")) | (day > F.col("observation_end")))).cast("long")).alias("outside"),
        F.sum((known & F.col("cancellation") & (F.datediff("observation_end", day) > final_days)).cast("long")).alias("early_cancellation"),
        F.sum((day > F.lit(ref).cast("date")).cast("long")).alias("after_reference"),
        F.sum((~known).cast("long")).alias("unknown_customer"),
    )
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("check"), F.coalesce(c, F.lit(0)).alias("n")) for c in one.columns))))


def ticket_reconciliation(accounts: DataFrame, threads: DataFrame, days: int = 90) -> DataFrame:
    """``(customer_id, declared, counted)`` where threads of the last days before the end differ from the declared number."""
    j = threads.join(accounts, "customer_id")
    day = F.to_date("created_at")
    inside = j.where((day <= F.col("observation_end")) & (F.datediff("observation_end", day) <= days)).groupBy("customer_id").agg(F.count("*").alias("counted"))
    both = accounts.join(inside, "customer_id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return both.where(F.coalesce("declared", F.lit(0)) != F.col("counted")).select("customer_id", "declared", "counted")


def churn_rates(df: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """``(grouping, value, n, rate)`` of each grouping, in one pass."""
    cells = F.array(*(F.struct(F.lit(n).alias("grouping"), c.cast("string").alias("value")) for n, c in groups.items()))
    return df.select("event", F.inline(cells)).groupBy("grouping", "value").agg(F.count("*").alias("n"), F.avg("event").alias("rate"))


def missingness_rates(df: DataFrame, keys: list[str], segment: Column, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``(key, overall, segment, in_band)``: missing shares, overall and inside the segment."""
    one = df.agg(
        *(F.avg(F.col(k).isNull().cast("int")).alias(f"o_{k}") for k in keys), *(F.avg(F.when(segment, F.col(k).isNull().cast("int"))).alias(f"s_{k}") for k in keys)
    )
    rows = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"o_{k}").alias("overall"), F.col(f"s_{k}").alias("segment")) for k in keys))
    return one.select(F.inline(rows)).withColumn("in_band", F.col("overall").between(low, high))


def truth_reconciliation(truth: DataFrame, actual: DataFrame, key: str = "code") -> DataFrame:
    """``(key, expected, actual, ok)``: counts by key on both sides."""
    a = truth.groupBy(key).agg(F.count("*").alias("expected"))
    b = actual.groupBy(key).agg(F.count("*").alias("actual"))
    j = a.join(b, key, "full").select(key, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
    return j.withColumn("ok", F.col("expected") == F.col("actual"))


def run_history(runs: DataFrame, status: str | None = None, model: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of runs, newest first, ids breaking ties."""
    if status:
        runs = runs.where(F.col("status") == status)
    if model:
        runs = runs.where(F.col("model_version") == model)
    return runs.orderBy(F.desc_nulls_last("created_at"), "run_id").offset(offset).limit(limit)


_STICKY = ("superseded_by", "created_at", "started_at", "finished_at")


def merge_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by run id; sticky columns keep the old value where the new one is NULL."""
    o, n = old.alias("o"), new.alias("n")
    j = o.join(n, F.col("o.run_id") == F.col("n.run_id"), "full")
    isnew = F.col("n.run_id").isNotNull()

    def value(c: str) -> Column:
        if c in _STICKY or c == "run_id":
            return F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
        return F.when(isnew, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return j.select(*(value(c).alias(c) for c in old.columns))


#: Runs that are under way, and those that go once their time is over. Fixed values.
IN_FLIGHT = ("queued", "pending", "running")
ENDED_EARLY = ("stopped", "interrupted", "failed")


def retention(runs: DataFrame, now: str, ttl_days: int = 30, keep: int = 100) -> DataFrame:
    """``(run_id, reason)`` of the runs to delete: ``expired`` ones, and those ``beyond newest``.

    A run's time is the first of finished, started and created. Runs that ended early expire after ``ttl_days``; of the
    rest, those not under way are ranked by time and id, and all but the newest ``keep`` go. Zero or less turns a rule off.
    """
    when = F.coalesce("finished_at", "started_at", "created_at").cast("timestamp")
    status = F.coalesce("status", F.lit(""))
    old = F.coalesce(when < F.lit(now).cast("timestamp") - F.make_dt_interval(days=F.lit(ttl_days)), F.lit(False))
    expired = status.isin(*ENDED_EARLY) & old if ttl_days > 0 else F.lit(False)
    rows = runs.select("run_id", F.struct(when.alias("at"), "run_id").alias("place"), expired.alias("gone"), status.isin(*IN_FLIGHT).alias("busy"))
    ranked = rows.where(~F.col("gone") & ~F.col("busy")) if keep > 0 else rows.limit(0)
    last = ranked.orderBy(F.desc("place")).limit(max(keep, 1)).agg(F.min("place").alias("last"))
    beyond = ~F.col("busy") & (F.col("place") < F.col("last"))
    judged = rows.crossJoin(F.broadcast(last))  # one row
    reason = F.when(F.col("gone"), "expired").when(beyond, "beyond newest")
    return judged.select("run_id", reason.alias("reason")).where("reason is not null")


def model_retention(models: DataFrame, runs: DataFrame, keep: int = 20) -> DataFrame:
    """``(model_version)`` of the saved models to delete: all but the newest ``keep`` by ``saved_at`` and name, save those
    that one of the ``runs`` refers to. Zero or less keeps all."""
    rows = models.select("model_version", F.struct("saved_at", "model_version").alias("place"))
    if keep <= 0:
        return rows.select("model_version").limit(0)
    last = rows.orderBy(F.desc("place")).limit(keep).agg(F.min("place").alias("last"))
    used = runs.select("model_version").where("model_version is not null").distinct()
    return rows.crossJoin(F.broadcast(last)).where(F.col("place") < F.col("last")).select("model_version").join(used, "model_version", "left_anti")


def reproducibility_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, difference)``: rows that only one side has, or whose other columns differ."""
    rest = [c for c in a.columns if c not in keys]
    digest = lambda df, n: df.select(*keys, F.sha2(F.to_json(F.struct(*rest)), 256).alias(n))
    j = digest(a, "ha").join(digest(b, "hb"), keys, "full")
    kind = F.when(F.col("ha").isNull(), "only recomputed").when(F.col("hb").isNull(), "only stored").when(F.col("ha") != F.col("hb"), "changed")
    return j.select(*keys, kind.alias("difference")).where("difference is not null")
