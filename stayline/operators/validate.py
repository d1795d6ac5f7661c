"""Row gates, batch gates and the feature gate of the canonical table.

Errors are rows ``(row_id, customer_id, code, field)``, all failures of a row reported. The only shuffle by
customer is the duplicate check; the batch gates are single aggregates.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import with_first
from ..functions.files import write_and_read
from ..functions.scalars import is_blank, to_float
from ..vocab import CORE_KEYS

MISSING_CODES = ("CORE_MISSING", "FEATURE_MISSING")
_NUMERIC = ("contract_length_months", "usage_frequency", "support_tickets_90d", "monthly_charges", "senior_citizen")


@dataclass(frozen=True)
class ValidationConfig:
    approved: tuple[str, ...] = CORE_KEYS
    features: dict[str, str] = field(default_factory=dict)
    missingness_threshold: float = 0.30
    pass_missing: bool = True
    max_zero_fraction: float = 0.80
    max_outlier_ratio: float = 0.05
    outlier_factor: float = 10.0
    promotion_min_events: int = 30
    correlation_threshold: float = 0.95


def core_keys(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema["core_features"].dataType.fields]


def feature_gate(df: DataFrame, cfg: ValidationConfig = ValidationConfig()) -> tuple[DataFrame, DataFrame]:
    """Moves core keys that aren't approved and undeclared model keys to the extras; ``(table, demotions per key)``."""
    keys = core_keys(df)
    kept, moved = [k for k in keys if k in cfg.approved], [k for k in keys if k not in cfg.approved]
    declared = F.array(*map(F.lit, cfg.features)).cast("array<string>")
    stray = F.map_filter("model_features", lambda k, _: ~F.array_contains(declared, k))
    down = F.map_filter(
        F.create_map(*(x for k in moved for x in (F.lit(k), F.col(f"core_features.{k}").cast("string")))).cast("map<string,string>"),
        lambda _, v: v.isNotNull(),
    )
    merged = F.map_concat(F.map_filter("extra_features", lambda k, _: ~F.map_contains_key(down, k) & ~F.map_contains_key(stray, k)), down, stray)
    gated = df.withColumn("demoted", F.concat(F.map_keys(down), F.map_keys(stray))).withColumn("extra_features", merged)
    gated = gated.withColumns(
        {
            "model_features": F.map_filter("model_features", lambda k, _: F.array_contains(declared, k)),
            "core_features": F.struct(*(F.col(f"core_features.{k}").alias(k) for k in kept)) if kept else F.struct(F.lit(None).cast("string").alias("none")),
        }
    )
    counts = gated.select(F.explode("demoted").alias("key")).groupBy("key").agg(F.count("*").alias("n_demoted"))
    return gated.drop("demoted"), counts


def _gate(condition: Column, code: str, name: str = "") -> Column:
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field")))


def with_errors(df: DataFrame, cfg: ValidationConfig, ref: str) -> DataFrame:
    """Adds ``errors`` (array of code and field) to every row. The first row of an id claims it, valid or not."""
    rows = with_first(df, "customer_id", "row_id", "_claimed_by")
    start, end, ref_day = F.col("observation_start"), F.col("observation_end"), F.lit(ref).cast("date")
    tenure = F.col("tenure")
    bad_tenure = tenure.isNull() | F.isnan(tenure) | (tenure < 0) | (tenure == float("inf"))
    keys = core_keys(df)
    gates = [
        _gate(is_blank(F.col("customer_id")), "CUSTOMER_ID"),
        _gate(F.col("row_id") > F.col("_claimed_by"), "UNIQUE_ID"),
        _gate(start.isNull(), "INVALID_DATE", "observation_start"),
        _gate(end.isNull(), "INVALID_DATE", "observation_end"),
        _gate(start > end, "WINDOW_ORDER"),
        _gate(F.col("event_observed").isNull() | ~F.col("event_observed").isin(0, 1), "EVENT_OBSERVED"),
        _gate(bad_tenure, "TENURE_INVALID"),
        _gate(~bad_tenure & (tenure != F.datediff(end, start)), "TENURE_MISMATCH"),
        _gate(end > ref_day, "FUTURE_LEAKAGE"),
        *(_gate(F.lit(True), "CORE_KEYS", k) for k in keys if k not in cfg.approved),
        *(_gate(is_blank(F.col(f"core_features.{k}")), "CORE_MISSING", k) for k in keys),
    ]
    value = lambda k: F.col("model_features")[k]
    has = lambda k: F.map_contains_key("model_features", F.lit(k))
    declared = F.array(*map(F.lit, cfg.features)).cast("array<string>")
    undeclared = F.size(F.array_except(F.map_keys("model_features"), declared)) > 0
    gates.append(_gate(undeclared, "FEATURE_KEYS"))
    for k, kind in cfg.features.items():
        gates.append(_gate(has(k) & is_blank(value(k)), "FEATURE_MISSING", k))
        if kind == "float":
            gates.append(_gate(has(k) & ~is_blank(value(k)) & to_float(value(k)).isNull(), "FEATURE_TYPE", k))
    return rows.withColumn("errors", F.filter(F.array(*gates), lambda e: e.isNotNull())).drop("_claimed_by")


def row_errors(df: DataFrame, cfg: ValidationConfig, ref: str) -> DataFrame:
    return with_errors(df, cfg, ref).select("row_id", "customer_id", F.inline("errors"))


def duplicate_ids(df: DataFrame, cfg: ValidationConfig, ref: str) -> DataFrame:
    return row_errors(df, cfg, ref).where("code = 'UNIQUE_ID'").select("row_id", "customer_id")


def _evaluable(gated: DataFrame) -> DataFrame:
    """Rows whose only errors are missing values."""
    return gated.where(F.forall("errors", lambda e: e["code"].isin(*MISSING_CODES)))


def by_tenure(gated: DataFrame, cfg: ValidationConfig) -> DataFrame:
    """``(tenure, n, m_<key>...)``: evaluable rows and missing values for each tenure, from which all batch gates follow.

    Tenure is whole days, so this has a row for each day that occurs, whatever the number of records.
    """
    emitted = core_keys(gated)
    missing = {k: is_blank(F.col(f"core_features.{k}")) if k in emitted else F.lit(True) for k in cfg.approved}
    missing |= {k: is_blank(F.col("model_features")[k]) for k in cfg.features}
    return _evaluable(gated).groupBy("tenure").agg(
        F.count("*").alias("n"), *(F.sum(c.cast("long")).alias(f"m_{k}") for k, c in missing.items())
    )


def missing_rates(days: DataFrame) -> DataFrame:
    """``(key, n_missing, n_evaluable, fraction)`` of every approved core key and declared feature."""
    keys = [c[2:] for c in days.columns if c.startswith("m_")]
    if not keys:
        return days.sparkSession.createDataFrame([], "key string, n_missing long, n_evaluable long, fraction double")
    one = days.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in days.columns if c != "tenure"))
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(f"m_{k}").alias("n_missing")) for k in keys))
    return one.select(F.col("n").alias("n_evaluable"), F.inline(pairs)).select(
        "key", "n_missing", "n_evaluable", F.try_divide("n_missing", "n_evaluable").alias("fraction")
    )


def missing_passthrough(days: DataFrame, cfg: ValidationConfig) -> DataFrame:
    """Rates of ``by_tenure`` with ``passes``: missing somewhere, in no more rows than the threshold."""
    passes = (F.col("fraction") > 0) & (F.col("fraction") <= cfg.missingness_threshold) & F.lit(cfg.pass_missing)
    return missing_rates(days).withColumn("passes", F.coalesce(passes, F.lit(False)))


def column_missingness(days: DataFrame, cfg: ValidationConfig) -> DataFrame:
    return missing_rates(days).withColumn(
        "fails", F.coalesce(F.col("fraction") > cfg.missingness_threshold, F.lit(False))
    )


def tenure_sanity(days: DataFrame, cfg: ValidationConfig) -> DataFrame:
    """One row with the shares and the verdict; medians are exact, over the counts of ``by_tenure``."""
    tenure = days.where("tenure is not null").select("tenure", "n")
    mid = tenure.agg(F.percentile("tenure", 0.5, F.col("n")).alias("median"))
    away = tenure.crossJoin(F.broadcast(mid))  # one row
    mad = away.agg(F.percentile(F.abs(F.col("tenure") - F.col("median")), 0.5, F.col("n")).alias("mad"))
    far = F.abs(F.col("tenure") - F.col("median")) > cfg.outlier_factor * F.col("scale")
    scaled = away.crossJoin(F.broadcast(mad)).withColumn(
        "scale", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.greatest(F.col("median") * 0.1, F.lit(1.0)))
    )
    share = lambda c: F.try_divide(F.sum(F.when(c, F.col("n")).otherwise(0)), F.sum("n"))
    return scaled.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        share(F.col("tenure") == 0).alias("zero_fraction"),
        F.max("median").alias("median"),
        F.max("scale").alias("scale"),
        share(far).alias("outlier_ratio"),
    ).withColumn(
        "sane",
        F.coalesce(
            (F.col("zero_fraction") <= cfg.max_zero_fraction) & (F.col("outlier_ratio") <= cfg.max_outlier_ratio), F.lit(True)
        ),
    )


@dataclass(frozen=True)
class Validated:
    accepted: DataFrame
    rejected: DataFrame
    errors: DataFrame
    report: DataFrame


def validate(df: DataFrame, cfg: ValidationConfig, ref: str) -> Validated:
    """Accepted and rejected rows (together the input), all errors, and the report.

    A key that is missing seldom enough passes as NULL. A failed batch gate rejects every row. The judged table is
    written once, to the shared folder, and everything below reads it. Its counts by day come to the driver, where the
    batch gates decide; rows never go there.
    """
    gated = write_and_read(with_errors(df, cfg, ref), "gated")
    counts = by_tenure(gated, cfg)
    days = df.sparkSession.createDataFrame(counts.collect(), counts.schema)
    passing = [r.key for r in missing_passthrough(days, cfg).where("passes").collect()]
    failing = [r for r in column_missingness(days, cfg).collect() if r.fails and r.key not in passing]
    sane = tenure_sanity(days, cfg).first()
    batch_errors = [("COLUMN_MISSINGNESS", r.key) for r in failing] + ([] if sane.sane else [("TENURE_SANITY", "")])
    ignored = F.array(*map(F.lit, passing)).cast("array<string>")
    final = gated.withColumn(
        "errors",
        F.filter("errors", lambda e: ~(e["code"].isin(*MISSING_CODES) & F.array_contains(ignored, e["field"]))),
    )
    ok = (F.size("errors") == 0) & F.lit(not batch_errors)
    accepted, rejected = final.where(ok).drop("errors"), final.where(~ok).drop("errors")
    errors = final.select("row_id", "customer_id", F.inline("errors"))
    if batch_errors:
        batch = df.sparkSession.createDataFrame([(None, None, c, f) for c, f in batch_errors], errors.schema)
        errors = errors.union(batch)
    counts = final.agg(F.count("*").alias("n_input"), F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias("n_accepted"))
    status = F.when(F.col("n_accepted") == 0, "FAILED").when(F.col("n_accepted") == F.col("n_input"), "PASSED").otherwise("PARTIAL")
    report = counts.select(
        "n_input", "n_accepted", (F.col("n_input") - F.col("n_accepted")).alias("n_rejected"), status.alias("status")
    )
    return Validated(accepted, rejected, errors, report)


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("code").agg(F.count("*").alias("n"))


def correlation_warnings(df: DataFrame, extras: list[str], cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """``(extra, core, r)`` of the numeric extras that correlate beyond the threshold with a numeric core key.

    An extra counts where all its filled cells are numbers. Cells become numbers once, in two projections before the one
    aggregate of all pairs, which only sees plain columns (parsing inside it is more code than Java compiles).
    """
    cores = [k for k in core_keys(df) if k in _NUMERIC]
    cells = df.select(
        *(F.col("extra_features")[e].alias(f"cell_{i}") for i, e in enumerate(extras)), *(F.col(f"core_features.{c}").alias(f"core_{j}") for j, c in enumerate(cores))
    )
    x = lambda i: F.col(f"x_{i}")
    cells = cells.withColumns({f"x_{i}": to_float(F.col(f"cell_{i}")) for i in range(len(extras))})
    cells = cells.withColumns({f"odd_{i}": (~is_blank(F.col(f"cell_{i}")) & x(i).isNull()).cast("int") for i in range(len(extras))})
    aggs = []
    for i, e in enumerate(extras):
        aggs.append(F.coalesce(F.sum(f"odd_{i}"), F.lit(0)).alias(f"bad_{e}"))
        for j, c in enumerate(cores):
            both = x(i).isNotNull() & F.col(f"core_{j}").isNotNull()
            aggs.append(F.corr(F.when(both, x(i)), F.when(both, F.col(f"core_{j}"))).alias(f"r_{e}_{c}"))
    pairs = [
        F.struct(F.lit(e).alias("extra"), F.lit(c).alias("core"), F.col(f"r_{e}_{c}").alias("r"), F.col(f"bad_{e}").alias("bad"))
        for e in extras
        for c in cores
    ]
    rows = cells.agg(*aggs).select(F.inline(F.array(*pairs)))
    return rows.where((F.col("bad") == 0) & (F.abs("r") > cfg.correlation_threshold) & ~F.isnan("r")).drop("bad")


def value_counts(long: DataFrame) -> DataFrame:
    """The long form ``(feature, value, event, tenure)`` counted by feature and value, from which all screening follows.

    ``filled``, ``x`` (the number in the cell), ``n`` rows, ``e`` events, ``z`` rows without one, and the sums of tenure.
    """
    t = F.col("tenure")
    return (
        long.groupBy("feature", "value")
        .agg(
            F.count("*").alias("n"), F.sum(F.col("event").cast("long")).alias("e"), F.count_if(F.col("event") == 0).alias("z"),
            F.count(t).alias("nt"), F.sum(t).alias("t"), F.sum(t * t).alias("tt"),
        )
        .select("*", (~is_blank(F.col("value"))).alias("filled"), to_float(F.col("value")).alias("x"))
    )


def evaluate_promotion(counts: DataFrame, cfg: ValidationConfig = ValidationConfig()) -> DataFrame:
    """``(feature, promote, reason, missing_fraction, association)`` from ``value_counts``."""
    filled, x = F.col("filled"), F.col("x")
    truthy = filled & (x.isNull() | (x != 0))

    def rate(c: Column) -> Column:
        return F.try_divide(F.sum(F.when(c, F.col("e"))), F.sum(F.when(c, F.col("e") + F.col("z"))))

    stats = counts.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(filled, F.col("n")).otherwise(0)).alias("present"),
        F.count_if(filled).alias("levels"),
        F.count_if(filled & x.isNull()).alias("words"),
        (F.min("x") == F.max("x")).alias("constant"),
        F.sum("e").alias("events"),
        (rate(truthy) - rate(filled)).alias("association"),
    )
    missing = 1 - F.col("present") / F.col("n")
    reason = (
        F.when(missing > cfg.missingness_threshold, "missingness")
        .when(F.col("levels") <= 1, "no variation")
        .when((F.col("words") == 0) & F.col("constant"), "no variation")
        .when(F.coalesce("events", F.lit(0)) < cfg.promotion_min_events, "sparse events")
        .otherwise("association")
    )
    return stats.select(
        "feature", (reason == "association").alias("promote"), reason.alias("reason"), missing.alias("missing_fraction"),
        F.coalesce("association", F.lit(0.0)).alias("association"),
    )
