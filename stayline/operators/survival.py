"""Survival tables: states, design matrix, gates, Kaplan-Meier, forward survival.

Tenure is whole days, so a fit is a grouping by day; what comes after has a few thousand rows at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z95


@dataclass(frozen=True)
class SurvivalConfig:
    min_customers: int = 200
    min_events: int = 30
    min_events_per_predictor: float = 10.0
    missingness_threshold: float = 0.30
    min_variation: float = 0.05
    correlation_threshold: float = 0.95
    vif_threshold: float = 5.0
    vif_min_predictors: int = 3
    penalizer: float = 0.1
    horizons: tuple[int, ...] = (30, 90, 180)
    horizon_min_customers: int = 50
    horizon_min_events: int = 5
    horizon_max_width: float = 0.30
    segment_min_customers: int = 50
    segment_min_events: int = 10
    cold_start_days: float = 30.0
    cold_start_min_features: int = 1
    bootstrap: int = 200
    ph_minor: float = 0.05
    ph_serious: float = 0.01
    max_levels: int = 50


@dataclass(frozen=True)
class FeatureSpec:
    """``levels``: sorted, the first is the reference; empty for numbers."""

    name: str
    kind: str
    levels: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [self.name] if self.kind == "numeric" else [f"{self.name}_{v}" for v in self.levels[1:]]


def feature_specs(df: DataFrame, predictors: list[str], cfg: SurvivalConfig = SurvivalConfig()) -> list[FeatureSpec]:
    """Numeric columns are numeric; text columns are categories. More levels than the cap are refused."""
    kinds = dict(df.dtypes)
    texts = [p for p in predictors if kinds[p] == "string"]
    levels = {}
    if texts:
        long = df.select(F.inline(F.array(*(F.struct(F.lit(t).alias("f"), F.col(t).alias("v")) for t in texts))))
        w = Window.partitionBy("f").orderBy("v")
        seen = long.where("v is not null").groupBy("f", "v").count().withColumn("k", F.row_number().over(w))
        for r in seen.where(F.col("k") <= cfg.max_levels + 1).orderBy("f", "v").collect():  # a few levels of each column
            levels.setdefault(r.f, []).append(r.v)
        for f, v in levels.items():
            if len(v) > cfg.max_levels:
                raise ValueError(f"{f} has more than {cfg.max_levels} levels")
    return [FeatureSpec(p, "categorical", tuple(levels.get(p, ()))) if p in texts else FeatureSpec(p, "numeric") for p in predictors]


def customer_states(df: DataFrame, predictors: list[str], cfg: SurvivalConfig = SurvivalConfig()) -> DataFrame:
    usable = sum((F.col(p).isNotNull().cast("int") for p in predictors), F.lit(0))
    state = (
        F.when(F.col("tenure") <= 0, "NOT_ENOUGH_DATA")
        .when((F.col("tenure") <= cfg.cold_start_days) & (usable < cfg.cold_start_min_features), "NOT_ENOUGH_DATA")
        .when(usable < len(predictors), "EXCLUDED")
        .otherwise("SCORED")
    )
    return df.withColumn("state", state)


def design_matrix(scored: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """``customer_id, duration, event``, numbers, raw categories and one column for each level but the reference."""
    columns: list[Column] = []
    for s in specs:
        if s.kind == "numeric":
            columns.append(F.col(s.name).cast("double").alias(s.name))
        else:
            columns.append(F.col(s.name).alias(f"{s.name}__raw"))
            columns += [(F.col(s.name) == v).cast("double").alias(f"{s.name}_{v}") for v in s.levels[1:]]
    return scored.select(
        "customer_id", F.col("tenure").cast("long").alias("duration"), F.col("event_observed").alias("event"), *columns
    )


def predictor_columns(specs: list[FeatureSpec]) -> list[str]:
    return [c for s in specs for c in s.columns]


def eligibility(matrix: DataFrame, specs: list[FeatureSpec], n_input: int, cfg: SurvivalConfig = SurvivalConfig()) -> DataFrame:
    """``(gate, value, ok)``; all gates from one aggregate."""
    cols = predictor_columns(specs)
    n, events = F.count("*"), F.coalesce(F.sum("event"), F.lit(0))
    modal = [
        F.avg((~F.col(c).eqNullSafe(F.col(f"mode_{c}"))).cast("int")).alias(f"v_{c}") for s in specs if s.kind == "numeric" for c in s.columns
    ]
    modes = matrix.agg(*(F.mode(s.name).alias(f"mode_{s.name}") for s in specs if s.kind == "numeric"), F.lit(1).alias("one"))
    seen = [F.max(F.greatest(*(F.col(c) for c in s.columns), F.lit(0.0))).alias(f"l_{s.name}") for s in specs if s.kind == "categorical"]
    one = matrix.crossJoin(F.broadcast(modes)).agg(n.alias("n"), events.alias("e"), *modal, *seen)  # one row of modes
    gates = [
        ("customers", F.col("n").cast("double"), F.col("n") >= cfg.min_customers),
        ("events", F.col("e").cast("double"), F.col("e") >= cfg.min_events),
        ("events_per_predictor", F.try_divide(F.col("e"), F.lit(len(cols))), F.col("e") >= cfg.min_events_per_predictor * len(cols)),
        ("excluded_share", 1 - F.col("n") / n_input, 1 - F.col("n") / n_input <= cfg.missingness_threshold),
    ]
    gates += [(f"variation {s.name}", F.col(f"v_{s.name}"), F.col(f"v_{s.name}") >= cfg.min_variation) for s in specs if s.kind == "numeric"]
    gates += [(f"levels {s.name}", F.col(f"l_{s.name}"), F.col(f"l_{s.name}") >= 1) for s in specs if s.kind == "categorical"]
    rows = F.array(
        *(F.struct(F.lit(g).alias("gate"), v.cast("double").alias("value"), F.coalesce(ok, F.lit(False)).alias("ok")) for g, v, ok in gates)
    )
    return one.select(F.inline(rows))


def eligibility_warnings(matrix: DataFrame, n_input: int, cfg: SurvivalConfig = SurvivalConfig()) -> DataFrame:
    """``(warning, value, raised)``."""
    top = matrix.agg(F.max("duration").alias("longest"))
    early = F.avg(F.when(F.col("event") == 1, (F.col("duration") < F.col("longest") / 2).cast("int")))
    one = matrix.crossJoin(F.broadcast(top)).agg(  # one row
        F.coalesce(F.sum("event"), F.lit(0)).alias("e"), F.count("*").alias("n"), F.percentile("duration", 0.5).alias("median"), early.alias("early")
    )
    out = 1 - F.col("n") / n_input
    rows = [
        ("few_events", F.col("e").cast("double"), F.col("e") < 2 * cfg.min_events),
        ("excluded", out, out > 0.05),
        ("short_tenure", F.col("median"), F.col("median") < 90),
        ("early_events", F.col("early"), F.col("early") > 0.6),
    ]
    return one.select(
        F.inline(F.array(*(F.struct(F.lit(w).alias("warning"), v.cast("double").alias("value"), F.coalesce(r, F.lit(False)).alias("raised")) for w, v, r in rows)))
    )


def collinear_pairs(matrix: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """``(a, b, r)`` beyond the threshold; all pairs in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = matrix.agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)), F.lit(1).alias("one"))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)))
    return one.select(F.inline(rows)).where((F.abs("r") > threshold) & ~F.isnan("r"))


def variance_inflation(matrix: DataFrame, columns: list[str]) -> dict[str, float]:
    """VIF of each column, from the correlation matrix (one aggregate); infinite where a column is a combination."""
    import numpy as np

    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    row = matrix.agg(*(F.corr(columns[i], columns[j]) for i, j in pairs), F.lit(1)).first()
    r = np.eye(p)
    for (i, j), v in zip(pairs, row):
        r[i, j] = r[j, i] = 0.0 if v is None or v != v else v
    out = {}
    for k, c in enumerate(columns):
        rest = [i for i in range(p) if i != k]
        if not rest:
            out[c] = 1.0
            continue
        fit = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, k], rcond=None)[0]
        r2 = float(r[k, rest] @ fit)
        out[c] = float("inf") if r2 >= 1 - 1e-12 else 1 / (1 - r2)
    return out


# --- Kaplan-Meier ------------------------------------------------------------------------------------------


def km_table(df: DataFrame, by: str | None = None) -> DataFrame:
    """``(stratum, duration, at_risk, deaths, censored, survival, greenwood)``: one row for each day of a stratum."""
    stratum = (F.col(by) if by else F.lit("all")).alias("stratum")
    days = df.groupBy(stratum, "duration").agg(
        F.count("*").alias("n"), F.sum("event").alias("deaths"), F.sum(1 - F.col("event")).alias("censored")
    )
    late = Window.partitionBy("stratum").orderBy(F.desc("duration"))
    so_far = Window.partitionBy("stratum").orderBy("duration")
    days = days.withColumn("at_risk", F.sum("n").over(late))
    d, n = F.col("deaths"), F.col("at_risk")
    log_step = F.when((d > 0) & (d < n), F.log(1 - d / n)).otherwise(0.0)
    dead = F.max((d >= n).cast("int")).over(so_far)
    return days.select(
        "stratum", "duration", "at_risk", "deaths", "censored",
        F.when(dead == 1, 0.0).otherwise(F.exp(F.sum(log_step).over(so_far))).alias("survival"),
        F.sum(F.when((d > 0) & (d < n), d / (n * (n - d))).otherwise(0.0)).over(so_far).alias("greenwood"),
    )


def loglog_interval(s: Column, g: Column, z: float = 1.96) -> tuple[Column, Column]:
    """S to the power of exp(-+ z sqrt(G) / |ln S|); NULL unless 0 < S < 1 and G > 0."""
    ok = (s > 0) & (s < 1) & (g > 0)
    theta = F.lit(z) * F.sqrt(F.when(ok, g)) / F.abs(F.log(F.when(ok, s)))
    return F.pow(F.when(ok, s), F.exp(theta)), F.pow(F.when(ok, s), F.exp(-theta))


def km_survival_at(table: DataFrame, horizons=(30, 90, 180)) -> DataFrame:
    """``(stratum, horizon, survival, lo, hi)``; before the first death survival is 1 and the interval is [1, 1]."""
    strata = table.groupBy("stratum").agg(
        *(F.max_by(F.when(F.col("duration") <= h, F.struct("survival", "greenwood")), F.when(F.col("duration") <= h, F.col("duration"))).alias(f"h{h}") for h in horizons)
    )
    at = strata.select("stratum", F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"h{h}.survival").alias("s"), F.col(f"h{h}.greenwood").alias("g")) for h in horizons))))
    s, g = F.coalesce("s", F.lit(1.0)), F.coalesce("g", F.lit(0.0))
    lo, hi = loglog_interval(s, g, Z95)
    certain = (s == 1.0) & (g == 0.0)
    return at.select(
        "stratum", "horizon", s.alias("survival"), F.when(certain, 1.0).otherwise(lo).alias("lo"), F.when(certain, 1.0).otherwise(hi).alias("hi")
    )


def km_segment(matrix: DataFrame, specs: list[FeatureSpec], cfg: SurvivalConfig = SurvivalConfig()) -> str | None:
    """The first category of which every level has enough customers and events."""
    for s in specs:
        if s.kind != "categorical" or len(s.levels) < 2:
            continue
        least = matrix.groupBy(f"{s.name}__raw").agg(F.count("*").alias("n"), F.sum("event").alias("e")).agg(F.min("n"), F.min("e")).first()
        if least[0] is not None and least[0] >= cfg.segment_min_customers and least[1] >= cfg.segment_min_events:
            return s.name
    return None


def horizon_status(df: DataFrame, table: DataFrame, cfg: SurvivalConfig = SurvivalConfig()) -> DataFrame:
    """``(horizon, n_observed, n_events, width, available)`` from the rows and their global life table."""
    counts = df.agg(
        *(F.sum((F.col("duration") >= h).cast("long")).alias(f"n{h}") for h in cfg.horizons),
        *(F.sum(((F.col("duration") >= h) & (F.col("event") == 1)).cast("long")).alias(f"e{h}") for h in cfg.horizons),
    )
    rows = counts.select(F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"n{h}").alias("n_observed"), F.col(f"e{h}").alias("n_events")) for h in cfg.horizons))))
    width = km_survival_at(table, cfg.horizons).select("horizon", (F.col("hi") - F.col("lo")).alias("width"))
    ok = (F.col("n_observed") >= cfg.horizon_min_customers) & (F.col("n_events") >= cfg.horizon_min_events) & (F.col("width") <= cfg.horizon_max_width)
    return rows.join(width, "horizon").withColumn("available", F.coalesce(ok, F.lit(False)))


def as_of(points: DataFrame, table: DataFrame) -> DataFrame:
    """``(stratum, day, survival, greenwood)`` of the last day of the table at or before each point (1 and 0 before all).

    Points and table are days of strata: a few thousand rows, merged in one window for each stratum.
    """
    marks = points.select("stratum", "day", F.lit(1).alias("kind"), F.lit(None).cast("struct<survival:double,greenwood:double>").alias("v"))
    steps = table.select("stratum", F.col("duration").alias("day"), F.lit(0).alias("kind"), F.struct("survival", "greenwood").alias("v"))
    w = Window.partitionBy("stratum").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = marks.union(steps).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("kind = 1")
    return last.select("stratum", "day", F.coalesce("v.survival", F.lit(1.0)).alias("survival"), F.coalesce("v.greenwood", F.lit(0.0)).alias("greenwood"))


def km_forward(df: DataFrame, table: DataFrame, days: int) -> DataFrame:
    """``(customer_id, forward, lo, hi)`` of active rows ``(customer_id, stratum, duration)`` within follow-up.

    Survival of the next days, given survival so far: S(s + t) / S(s), with Greenwood's sum over the same window.
    Rows whose window passes the last observed day get nothing.
    """
    ends = table.groupBy("stratum").agg(F.max("duration").alias("longest"))
    active = df.where("event = 0").select("customer_id", "stratum", "duration")
    starts = active.select("stratum", "duration").distinct().join(ends, "stratum").where(F.col("duration") + days <= F.col("longest"))
    points = starts.select("stratum", F.explode(F.array(F.col("duration"), F.col("duration") + days)).alias("day")).distinct()
    at = as_of(points, table)
    now = at.select("stratum", F.col("day").alias("duration"), F.col("survival").alias("s0"), F.col("greenwood").alias("g0"))
    then = at.select("stratum", (F.col("day") - days).alias("duration"), F.col("survival").alias("s1"), F.col("greenwood").alias("g1"))
    by_day = starts.join(now, ["stratum", "duration"]).join(then, ["stratum", "duration"])
    forward = F.when(F.col("s0") > 0, F.col("s1") / F.col("s0"))
    g = F.when(F.col("s1") > 0, F.col("g1") - F.col("g0"))
    lo, hi = loglog_interval(forward, g)
    values = by_day.select("stratum", "duration", forward.alias("forward"), lo.alias("lo"), hi.alias("hi"))
    return active.join(values, ["stratum", "duration"]).select("customer_id", "forward", "lo", "hi")
