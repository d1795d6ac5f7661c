"""Ranking of accounts from survival scores and support signals.

``combine`` makes one wide row for each customer; every later step adds columns to it without a shuffle, but for
the base rate (one aggregate) and the global rank (quantile buckets, so that no task sorts everything).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.files import write_and_read
from ..functions.ranks import global_rank
from ..functions.scalars import clip, exact, half_even, lookup
from ..vocab import HIERARCHY_WEIGHT, LEVELS, LIFT_POINTS, MODEL_CONFIDENCE, STRENGTH_ORDER, STRENGTH_SCORE


@dataclass(frozen=True)
class RankingConfig:
    quantitative_weight: float = 0.6
    qualitative_weight: float = 0.4
    agreement_bonus: float = 0.05
    medium: float = 0.4
    high: float = 0.7
    quant_medium: float = 0.4
    quant_high: float = 0.7
    confidence_quant: float = 0.55
    confidence_qual: float = 0.45
    base_min_customers: int = 30
    precision_width: float = 0.2
    precision_floor: float = 0.5
    maturity_days: float = 180.0
    history_floor: float = 0.5
    max_drivers: int = 5
    lift_points: tuple = LIFT_POINTS


def first_of_each(df: DataFrame, order: str = "pos") -> DataFrame:
    """Each customer's first row, without ``order``. Tasks find their first rows before any are brought together."""
    rest = [c for c in df.columns if c not in ("customer_id", order)]
    first = df.groupBy("customer_id").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    return first.select("customer_id", *(F.col(f"_row.{c}").alias(c) for c in rest))


def account_universe(scores: DataFrame, support: DataFrame, order: str = "pos") -> DataFrame:
    """``(customer_id, in_scores, in_support, repeats)``: union of both sides; repeats count rows after the first."""
    a = scores.groupBy("customer_id").agg(F.count("*").alias("na"))
    b = support.groupBy("customer_id").agg(F.count("*").alias("nb"))
    z = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, "customer_id", "full").select(
        "customer_id", (z("na") > 0).alias("in_scores"), (z("nb") > 0).alias("in_support"),
        (F.greatest(z("na") - 1, F.lit(0)) + F.greatest(z("nb") - 1, F.lit(0))).alias("repeats"),
    )


def combine(scores: DataFrame, support: DataFrame, flags: DataFrame) -> DataFrame:
    """One row for each customer of either side. A customer has at most one flag of each type."""
    per = flags.groupBy("customer_id").agg(
        F.array_sort(F.collect_list(F.struct("flag_type", "severity", "signal_strength", "recurrence", "message_ids"))).alias("flags")
    )
    j = first_of_each(scores).join(first_of_each(support), "customer_id", "full").join(per, "customer_id", "left")
    none = F.array().cast(per.schema["flags"].dataType)
    status = F.coalesce("status", F.lit("no_data"))
    scored = F.col("state") == "SCORED"
    has_flags = F.size(F.coalesce("flags", none)) > 0
    only = lambda c: F.when(scored, F.col(c))
    usable = F.coalesce("survival_90", "risk_score", "forward_90").isNotNull()
    span = F.col("forward_hi") - F.col("forward_lo")
    width = F.when(scored & span.isNotNull(), F.greatest(F.lit(0.0), span))
    return j.select(
        "customer_id", F.coalesce("state", F.lit("NOT_ENOUGH_DATA")).alias("state"), only("survival_90").alias("survival_90"),
        only("risk_score").alias("risk_score"), only("forward_90").alias("forward_90"), width.alias("ci_width"),
        "tenure_days", "event_observed", (scored & ~usable).alias("partial_alignment"),
        status.alias("status"), F.coalesce("n_threads", F.lit(0)).alias("n_threads"), F.coalesce("support_confidence", F.lit(0.0)).alias("support_confidence"),
        F.coalesce("urgency", F.lit("unknown")).alias("urgency"), F.coalesce("churn_language", F.lit(False)).alias("churn_language"),
        ((status == "no_data") & has_flags).alias("inconsistent_support"),
        F.when(status == "no_data", none).otherwise(F.coalesce("flags", none)).alias("flags"),
    )


def split_churned(accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    churned = F.coalesce(F.col("event_observed") == 1, F.lit(False))
    return accounts.where(~churned), accounts.where(churned).select("customer_id", "tenure_days")


def base_rate(accounts: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """One row ``(base_rate, n, use_lift)`` over active customers with a forward value."""
    value = F.when(~F.coalesce(F.col("event_observed") == 1, F.lit(False)), 1 - F.col("forward_90"))
    one = accounts.agg(F.avg(value).alias("base_rate"), F.count(value).alias("n"))
    return one.withColumn("use_lift", F.coalesce((F.col("n") >= cfg.base_min_customers) & (F.col("base_rate") > 0), F.lit(False)))


def lift_risk(p: Column, base: Column, points=LIFT_POINTS) -> tuple[Column, Column]:
    """``(risk, lift)``: the piecewise-linear map of p / base, flat beyond the last point."""
    lift = F.when(p.isNotNull(), F.greatest(F.lit(0.0), p) / base)  # greatest() would take NULL for 0
    risk = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        risk = F.when(lift <= x1, y0 + (y1 - y0) * (lift - x0) / (x1 - x0)).otherwise(risk)
    risk = F.when(lift.isNotNull(), risk)
    return clip(half_even(risk)), half_even(lift)


def absolute_risk(survival: Column, risk: Column) -> Column:
    return clip(half_even(F.coalesce(1 - survival, risk)))


def quantitative(accounts: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """Adds ``quant, lift, forward_status, base_rate``: on the lift scale where enough active customers carry it."""
    accounts = write_and_read(accounts, "accounts")  # the base rate and every row read it
    base = base_rate(accounts, cfg).select("base_rate", "use_lift")
    rows = accounts.crossJoin(F.broadcast(base))  # one row
    usable_base = F.when(F.col("use_lift"), F.col("base_rate"))
    risk, lift = lift_risk(1 - F.col("forward_90"), usable_base, cfg.lift_points)
    active = F.coalesce(F.col("event_observed") != 1, F.lit(True))
    status = (
        F.when(~F.col("use_lift"), None).when(F.col("forward_90").isNotNull(), "available")
        .when((F.col("state") == "SCORED") & active, "beyond_follow_up").otherwise("unavailable")
    )
    return rows.withColumns(
        {
            "quant": F.when(F.col("use_lift"), risk).otherwise(absolute_risk(F.col("survival_90"), F.col("risk_score"))),
            "lift": F.when(F.col("use_lift"), lift),
            "forward_status": status,
        }
    )


def _risky(flags: str = "flags") -> Column:
    return F.filter(flags, lambda f: f["flag_type"] != "positive_feedback")


def top_flags(flags: str = "flags") -> Column:
    """Risk flags by strength, weight, recurrence (largest first) and type."""
    keyed = F.transform(
        _risky(flags),
        lambda f: F.struct(
            (-lookup(f["signal_strength"], STRENGTH_ORDER)).alias("o"), (-lookup(f["flag_type"], HIERARCHY_WEIGHT)).alias("w"),
            (-f["recurrence"]).alias("r"), f["flag_type"].alias("flag_type"), f["severity"].alias("severity"),
            f["signal_strength"].alias("signal_strength"), f["recurrence"].alias("recurrence"),
        ),
    )
    return F.transform(F.array_sort(keyed), lambda f: F.struct(*(f[c].alias(c) for c in ("flag_type", "severity", "signal_strength", "recurrence"))))


def qualitative_score(status: Column, flags: str = "flags") -> Column:
    risky = _risky(flags)
    best = F.array_max(F.transform(risky, lambda f: lookup(f["flag_type"], HIERARCHY_WEIGHT) * lookup(f["signal_strength"], STRENGTH_SCORE)))
    most = F.array_max(F.transform(risky, lambda f: f["recurrence"]))
    bonus = F.least(F.lit(0.2), 0.05 * F.greatest(F.lit(0), most - 1))
    return F.when((status == "no_data") | (F.size(risky) == 0), 0.0).otherwise(F.least(F.lit(1.0), exact(best + bonus)))


def combined_score(quant: Column, qual: Column, strongest: Column, cfg: RankingConfig = RankingConfig(), quantitative_only: bool = False) -> Column:
    q = F.coalesce(quant, F.lit(0.0))
    if quantitative_only:
        return clip(q)
    agree = F.coalesce((quant >= cfg.quant_high) & (strongest == "strong"), F.lit(False))
    return clip(cfg.quantitative_weight * q + exact(cfg.qualitative_weight * qual) + F.when(agree, cfg.agreement_bonus).otherwise(0.0))


def critical_rules(quant: Column, flags: str = "flags", cfg: RankingConfig = RankingConfig()) -> Column:
    """The names of the rules that hold, in order."""
    risky = _risky(flags)
    high = F.coalesce(quant >= cfg.quant_high, F.lit(False))
    is_cancel = lambda f: f["flag_type"] == "cancellation_intent"
    meaningful = lambda f: f["signal_strength"].isin("moderate", "strong")
    significant = lambda f: f["severity"].isin("medium", "high") | meaningful(f)
    strong = lambda f: f["signal_strength"] == "strong"
    rules = (
        ("critical_cancellation_intent", F.exists(risky, lambda f: is_cancel(f) & meaningful(f))),
        ("critical_cancellation_plus_significant_flag", F.exists(risky, lambda f: is_cancel(f) & strong(f)) & F.exists(risky, lambda f: ~is_cancel(f) & significant(f))),
        ("critical_high_quant_plus_contract_concern", high & F.exists(risky, lambda f: (f["flag_type"] == "renewal_or_contract_concern") & strong(f))),
        ("critical_repeated_high_severity_plus_high_quant", high & F.exists(risky, lambda f: (f["severity"] == "high") & (f["recurrence"] >= 2))),
    )
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules)))


def risk_level(score: Column, rules: Column, quant: Column, status: Column, cfg: RankingConfig = RankingConfig()) -> Column:
    return (
        F.when(quant.isNull() & (status == "no_data"), "insufficient_data").when(F.size(rules) > 0, "critical")
        .when(score >= cfg.high, "high").when(score >= cfg.medium, "medium").otherwise("low")
    )


def account_confidence(model_status: str, width: Column, tenure: Column, quant: Column, support: Column, cfg: RankingConfig = RankingConfig()) -> tuple[Column, Column]:
    """``(quantitative, combined)``; zero where the quantitative score is missing."""
    precision = F.when(width.isNull(), cfg.precision_floor).otherwise(1 - clip(width / cfg.precision_width))
    maturity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(tenure, F.lit(0.0))) / cfg.maturity_days)
    history = cfg.history_floor + (1 - cfg.history_floor) * maturity
    own = clip(half_even(F.lit(MODEL_CONFIDENCE[model_status]) * half_even(precision) * half_even(history)))
    own = F.when(quant.isNull(), 0.0).otherwise(own)
    return own, clip(half_even(cfg.confidence_quant * own + cfg.confidence_qual * support))


def reasons(cfg: RankingConfig = RankingConfig()) -> Column:
    """Ordered structured reasons of an account row (after ``score_accounts``' other columns)."""
    q, rules, status = F.col("quant"), F.col("rules"), F.col("status")
    strongest, risky = F.get("top_flags", F.lit(0)), _risky()
    named = lambda n, c, source, severity, evidence: F.when(
        F.coalesce(c, F.lit(False)),
        F.struct(F.lit(n).alias("reason_type"), F.lit(source).alias("source"), F.lit(severity).alias("severity"), evidence.cast("string").alias("evidence")),
    )
    rule = lambda n, e: named(n, F.array_contains(rules, n), "node3", "critical", e)
    repeated = F.filter(risky, lambda f: f["recurrence"] >= 2)
    positive = F.exists("flags", lambda f: f["flag_type"] == "positive_feedback")
    cancel = F.exists("flags", lambda f: (f["flag_type"] == "cancellation_intent") & f["signal_strength"].isin("moderate", "strong"))
    conflict = ((q >= cfg.quant_high) & (positive | (status == "no_data"))) | ((q < cfg.quant_medium) & cancel)
    conflict = F.coalesce(conflict, F.lit(False))
    kinds = F.array_join(F.transform(repeated, lambda f: f["flag_type"]), ",")
    built = F.array(
        rule("critical_cancellation_intent", F.lit("cancellation_intent")),
        rule("critical_cancellation_plus_significant_flag", F.array_join(F.transform(risky, lambda f: f["flag_type"]), ",")),
        rule("critical_high_quant_plus_contract_concern", q),
        rule("critical_repeated_high_severity_plus_high_quant", q),
        named("missing_quantitative_data", q.isNull(), "node2", "low", F.col("state")),
        named("high_quantitative_risk", q >= cfg.quant_high, "node2", "high", q),
        named("moderate_quantitative_risk", (q >= cfg.quant_medium) & (q < cfg.quant_high), "node2", "medium", q),
        named("missing_support_data", status == "no_data", "node3", "low", status),
        named("limited_support_data", status == "limited_data", "node3", "low", status),
        named("strong_support_signal", strongest["signal_strength"] == "strong", "node3", "high", strongest["flag_type"]),
        named("moderate_support_signal", strongest["signal_strength"] == "moderate", "node3", "medium", strongest["flag_type"]),
        named("repeated_support_issue", F.size(repeated) > 0, "node3", "high", kinds),
        named("high_support_urgency", F.col("urgency") == "high", "node3", "high", F.col("urgency")),
        named("quantitative_qualitative_conflict", conflict, "node2", "medium", q),
        named("quantitative_qualitative_agreement", ~conflict & (q >= cfg.quant_high) & (strongest["signal_strength"] == "strong"), "node2", "low", q),
    )
    return F.array_compact(built)


def score_accounts(accounts: DataFrame, model_status: str = "READY", cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """Adds scores, rules, level, confidence and reasons to active accounts."""
    rows = quantitative(accounts, cfg).withColumn("top_flags", top_flags()).withColumn("qual", qualitative_score(F.col("status")))
    rows = rows.withColumn("strongest", F.coalesce(F.get("top_flags", F.lit(0))["signal_strength"], F.lit("none")))
    rows = rows.withColumn("rules", critical_rules(F.col("quant"), cfg=cfg))
    rows = rows.withColumn("score", combined_score(F.col("quant"), F.col("qual"), F.col("strongest"), cfg))
    own, both = account_confidence(model_status, F.col("ci_width"), F.col("tenure_days"), F.col("quant"), F.col("support_confidence"), cfg)
    rows = rows.withColumns({"quant_confidence": own, "confidence": both, "level": risk_level(F.col("score"), F.col("rules"), F.col("quant"), F.col("status"), cfg)})
    return rows.withColumn("reasons", reasons(cfg))


def rank_accounts(scored: DataFrame) -> DataFrame:
    """Adds ``rank`` 1..n in the total order; accounts with insufficient data are left out."""
    level = lookup(F.col("level"), {n: k for k, n in enumerate(LEVELS)})
    rows = scored.where("level != 'insufficient_data'").withColumn("_level", level)
    order = [
        F.col("_level"), F.desc("score"), F.desc("churn_language"), F.desc(lookup(F.col("strongest"), STRENGTH_ORDER)),
        F.desc_nulls_last("quant"), F.desc("confidence"), F.col("customer_id"),
    ]
    return global_rank(rows, order).drop("_level")


def ranking_summary(scored: DataFrame, churned: DataFrame) -> DataFrame:
    """``(item, n)``."""
    counts = scored.groupBy(F.col("level").alias("item")).agg(F.count("*").alias("n"))
    return counts.union(churned.agg(F.count("*").alias("n")).select(F.lit("churned"), "n"))


def evidence_refs(accounts: DataFrame) -> DataFrame:
    """``(customer_id, message_ids)``: distinct ids of the flags, in the flags' order."""
    ids = F.array_distinct(F.flatten(F.transform("flags", lambda f: F.split(f["message_ids"], ","))))
    return accounts.select("customer_id", F.array_join(ids, ",").alias("message_ids"))


def top_drivers(contributions: DataFrame, cfg: RankingConfig = RankingConfig()) -> DataFrame:
    """``(customer_id, drivers)`` from ``(customer_id, contributions)``: positive, reliable, largest first."""
    kept = F.filter("contributions", lambda c: (c["contribution"] > 0) & c["reliable"])
    keyed = F.array_sort(F.transform(kept, lambda c: F.struct((-c["contribution"]).alias("k"), c["feature"].alias("feature"))))
    names = F.transform(F.slice(keyed, 1, cfg.max_drivers), lambda c: c["feature"])
    return contributions.select("customer_id", F.array_join(names, ",").alias("drivers"))
