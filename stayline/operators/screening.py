"""Screening of candidate features on the long form ``(feature, customer_id, value, event, tenure)``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import write_and_read
from ..functions.ranks import running_sum
from ..vocab import LEAKY_NAMES
from .validate import ValidationConfig, evaluate_promotion, value_counts


@dataclass(frozen=True)
class ScreeningConfig:
    auc_block: float = 0.95
    auc_warn: float = 0.85
    max_levels_block: int = 50
    max_levels_warn: int = 20
    gap_block: float = 0.9
    gap_warn: float = 0.5
    pure_min_rows: int = 20
    pure_min_share: float = 0.05
    tenure_block: float = 0.98


def long_form(df: DataFrame, features: dict) -> DataFrame:
    """One row for each record and feature: any number of features costs one pass."""
    cells = F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("string").alias("value")) for n, c in features.items()))
    return df.select("customer_id", F.col("event_observed").alias("event"), "tenure", F.inline(cells))


def feature_profile(counts: DataFrame) -> DataFrame:
    """``(feature, kind, n_evaluable, n_present, missing_fraction, presence_gap)`` from ``value_counts``."""
    filled = F.col("filled")
    held = lambda c: F.sum(F.when(filled, F.col(c)).otherwise(0))
    gap = F.abs(F.try_divide(held("e"), F.sum("e")) - F.try_divide(held("z"), F.sum("z")))
    words, present = F.count_if(filled & F.col("x").isNull()), held("n")
    return counts.groupBy("feature").agg(
        F.when((present > 0) & (words == 0), "number").otherwise("category").alias("kind"),
        F.sum("n").alias("n_evaluable"),
        present.alias("n_present"),
        (1 - present / F.sum("n")).alias("missing_fraction"),
        F.coalesce(gap, F.lit(0.0)).alias("presence_gap"),
    )


def _scores(counts: DataFrame) -> DataFrame:
    """``(feature, kind, x, n, e)``: a number stands for itself, a level for its share of events."""
    filled = counts.where("filled")
    numbers = filled.where("x is not null").select("feature", F.lit("number").alias("kind"), "x", "n", "e")
    levels = filled.select("feature", F.lit("category").alias("kind"), (F.col("e") / F.col("n")).alias("x"), "n", "e")
    return numbers.union(levels).groupBy("feature", "kind", "x").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def rank_sums(counts: DataFrame, *kinds: str) -> DataFrame:
    """``(feature, kind, raw_auc)`` of both readings of each feature: rank sums with average ranks for ties, in one pass."""
    by = ["feature", "kind"]
    running = running_sum(_scores(counts).where(F.col("kind").isin(*kinds)), by, "x", "n", "cum")
    mid = F.col("cum") - F.col("n") + (F.col("n") + 1) / 2
    sums = running.groupBy(*by).agg(F.sum(mid * F.col("e")).alias("r"), F.sum("e").alias("p"), F.sum("n").alias("all"))
    p, q = F.col("p"), F.col("all") - F.col("p")
    return sums.select(*by, F.when((p > 0) & (q > 0), (F.col("r") - p * (p + 1) / 2) / (p * q)).alias("raw_auc"))


def rank_auc(counts: DataFrame) -> DataFrame:
    """``(feature, auc, direction)`` of numeric cells."""
    raw = F.col("raw_auc")
    return rank_sums(counts, "number").select(
        "feature",
        F.greatest(raw, 1 - raw).alias("auc"),
        F.when(raw > 0.5, "higher_more_churn").when(raw < 0.5, "higher_less_churn").alias("direction"),
    )


def level_counts(counts: DataFrame, cfg: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """``(feature, n_levels, n_pure, levels_verdict)`` of text cells; the size that a pure level needs is known first."""
    levels = counts.where("filled")
    sizes = levels.groupBy("feature").agg(F.count("*").alias("n_levels"), F.sum("n").alias("present"))
    least = F.greatest(F.lit(cfg.pure_min_rows), F.ceil(F.col("present") * cfg.pure_min_share))
    pure = (F.col("n") >= least) & ((F.col("e") == 0) | (F.col("e") == F.col("n")))
    verdict = (
        F.when(F.col("n_levels") > cfg.max_levels_block, "block")
        .when((F.col("n_pure") > 0) & (F.col("n_levels") > 1), "block")
        .when(F.col("n_levels") > cfg.max_levels_warn, "warn")
        .otherwise("ok")
    )
    counted = levels.join(sizes, "feature").groupBy("feature").agg(
        F.max("n_levels").alias("n_levels"), F.sum(pure.cast("long")).alias("n_pure")
    )
    return counted.withColumn("levels_verdict", verdict)


def category_screen(counts: DataFrame, cfg: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """``(feature, n_levels, auc, n_pure, levels_verdict)`` of text cells."""
    raw = F.col("raw_auc")
    auc = rank_sums(counts, "category").select("feature", F.greatest(raw, 1 - raw).alias("auc"))
    return level_counts(counts, cfg).join(auc, "feature").select("feature", "n_levels", "auc", "n_pure", "levels_verdict")


def tenure_correlation(counts: DataFrame) -> DataFrame:
    """``(feature, tenure_correlation)`` from sums over the values; NULL where a side doesn't vary."""
    x, has = F.col("x"), F.col("x").isNotNull()
    part = lambda c: F.sum(F.when(has, c).otherwise(0.0))
    sums = counts.groupBy("feature").agg(
        part(F.col("nt")).alias("n"), part(x * F.col("nt")).alias("sx"), part(x * x * F.col("nt")).alias("sxx"),
        part(F.col("t")).alias("st"), part(F.col("tt")).alias("stt"), part(x * F.col("t")).alias("sxt"),
    )
    n = F.col("n")
    vx, vt = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("stt") - F.col("st") ** 2
    # rounding leaves about this much of a variance that is nought
    varies = (vx > 1e-12 * n * F.col("sxx")) & (vt > 1e-12 * n * F.col("stt"))
    r = (n * F.col("sxt") - F.col("sx") * F.col("st")) / F.sqrt(vx * vt)
    return sums.select("feature", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("tenure_correlation"))


def screen_features(long: DataFrame, cfg: ScreeningConfig = ScreeningConfig(), gates: ValidationConfig = ValidationConfig()) -> DataFrame:
    """``(feature, kind, verdict, block, warn)``: reason codes joined by commas, in a fixed order.

    The records are counted once, by feature and value; every statistic is an aggregate of that table.
    """
    counts = write_and_read(value_counts(long), "value-counts")
    profile = feature_profile(counts)
    promotion = evaluate_promotion(counts, gates).select("feature", "promote", "reason")
    raw = F.col("raw_auc")
    auc = rank_sums(counts, "number", "category").select("feature", "kind", F.greatest(raw, 1 - raw).alias("auc"))
    all_ = profile.join(promotion, "feature").join(auc, ["feature", "kind"], "left")
    all_ = all_.join(level_counts(counts, cfg), "feature", "left").join(tenure_correlation(counts), "feature", "left")
    number = F.col("kind") == "number"
    category = ~number
    block = F.array_compact(
        F.array(
            F.when(~F.col("promote") & (F.col("reason") != "sparse events"), "promotion"),
            F.when(F.col("presence_gap") >= cfg.gap_block, "presence"),
            F.when(number & (F.abs("tenure_correlation") >= cfg.tenure_block), "tenure"),
            F.when(category & (F.col("n_levels") > cfg.max_levels_block), "levels"),
            F.when(category & (F.col("n_pure") > 0) & (F.col("n_levels") > 1), "pure level"),
            F.when(F.col("auc") >= cfg.auc_block, "auc"),
        )
    )
    warn = F.array_compact(
        F.array(
            F.when(~F.col("promote") & (F.col("reason") == "sparse events"), "sparse events"),
            F.when((F.col("presence_gap") >= cfg.gap_warn) & (F.col("presence_gap") < cfg.gap_block), "presence"),
            F.when(category & F.col("n_levels").between(cfg.max_levels_warn + 1, cfg.max_levels_block), "levels"),
            F.when((F.col("auc") >= cfg.auc_warn) & (F.col("auc") < cfg.auc_block), "auc"),
            F.when(F.lower("feature").rlike(LEAKY_NAMES), "name"),
        )
    )
    verdict = F.when(F.size(block) > 0, "block").when(F.size(warn) > 0, "warn").otherwise("ok")
    return all_.select(
        "feature", "kind", verdict.alias("verdict"), F.array_join(block, ",").alias("block"), F.array_join(warn, ",").alias("warn")
    )
