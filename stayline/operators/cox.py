"""Cox proportional hazards from sums per day.

Every Newton step groups the rows by (stratum, day): weights, weighted covariates and their products, over all
rows and over events. What comes to the driver is one row for each day; Efron's corrections, risk sets (suffix
sums) and the small solve happen there. Covariates are standardised by mean and sample deviation; the objective
is the log-likelihood over n less half the ridge penalty.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import write_and_read
from ..functions.scalars import clip
from ..functions.stats import normal_p, t_p
from .survival import (
    FeatureSpec, SurvivalConfig, as_of, collinear_pairs, customer_states, design_matrix, eligibility, eligibility_warnings, feature_specs,
    horizon_status, km_forward, km_segment, km_survival_at, km_table, predictor_columns, variance_inflation,
)


class CoxFailure(ValueError):
    """The fit can't be had; callers fall back to life tables."""


@dataclass
class CoxModel:
    columns: list[str]
    beta: list[float]
    mean: list[float]
    sd: list[float]
    cov: list[list[float]]
    n: int
    n_events: int
    strata: str | None = None
    #: (stratum, day, cumulative hazard, deaths, sum of deaths / at risk ** 2 so far, at risk) in order
    baseline: list[tuple] = field(default_factory=list)

    def linear(self) -> Column:
        """(x - mean) beta."""
        return sum(((F.col(f"`{c}`") - m) * b for c, m, b in zip(self.columns, self.mean, self.beta)), F.lit(0.0))


def _sums(matrix: DataFrame, columns, mean, sd, beta, strata: str | None):
    """Per-day sums as NumPy arrays by stratum, latest day first."""
    import numpy as np

    p = len(columns)
    x = [(F.col(f"`{c}`") - m) / s for c, m, s in zip(columns, mean, sd)]
    w = F.exp(sum((float(b) * xi for b, xi in zip(beta, x)), F.lit(0.0)))
    staged = matrix.select(
        (F.col(f"`{strata}__raw`") if strata else F.lit("all")).alias("stratum"), "duration", F.col("event").cast("double").alias("e"),
        w.alias("w"), *(xi.alias(f"x{i}") for i, xi in enumerate(x)),
    )
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    e, xs = F.col("e"), [F.col(f"x{i}") for i in range(p)]
    aggs = [F.sum("w"), F.sum(e), F.sum(e * F.col("w"))]
    for factor in (F.col("w"), e * F.col("w"), e):
        aggs += [F.sum(factor * a) for a in xs] + [F.sum(factor * xs[i] * xs[j]) for i, j in pairs]
    rows = staged.groupBy("stratum", "duration").agg(*(a.alias(f"a{k}") for k, a in enumerate(aggs)), F.count("*").alias("n")).collect()
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: -r.duration):
        by.setdefault(r.stratum, []).append(r)
    block = p + len(pairs)
    out = {}
    for s, rs in sorted(by.items()):
        a = np.array([[float(v) for v in r[2:-1]] for r in rs])
        part = [a[:, 3 + k * block : 3 + (k + 1) * block] for k in range(3)]

        def square(m):
            full = np.zeros((len(m), p, p))
            for k, (i, j) in enumerate(pairs):
                full[:, i, j] = full[:, j, i] = m[:, p + k]
            return full

        out[s] = {
            "day": np.array([r.duration for r in rs]), "n": np.cumsum([r.n for r in rs]), "d": a[:, 1],
            "S0": np.cumsum(a[:, 0]), "S1": np.cumsum(part[0][:, :p], 0), "S2": np.cumsum(square(part[0]), 0),
            "D0": a[:, 2], "D1": part[1][:, :p], "D2": square(part[1]), "X1": part[2][:, :p], "X2": square(part[2]),
        }
    return out


def _tie_sums(s0: float, d0: float, d: int, chunk: int = 1 << 16):
    """Efron's sums over the d deaths of a day: log phi, and a ** i / phi ** j for the (i, j) that the derivatives need,
    where a = k / d and phi = s0 - a d0. In pieces, so that a day of many deaths needs no more memory."""
    import numpy as np

    total = np.zeros(6)
    for at in range(0, d, chunk):
        a = np.arange(at, min(d, at + chunk)) / d
        phi = s0 - a * d0
        total += [np.log(phi).sum(), (1 / phi).sum(), (a / phi).sum(), (1 / phi**2).sum(), (a / phi**2).sum(), (a * a / phi**2).sum()]
    return total


def _likelihood(sums, beta):
    """Efron log-likelihood, gradient and Hessian."""
    import numpy as np

    p = len(beta)
    ll, g, h = 0.0, np.zeros(p), np.zeros((p, p))
    for s in sums.values():
        for t in np.flatnonzero(s["d"] > 0):
            logs, u, v, uu, uv, vv = _tie_sums(s["S0"][t], s["D0"][t], int(round(s["d"][t])))
            s1, d1 = s["S1"][t], s["D1"][t]
            cross = np.outer(s1, d1)
            ll += float(beta @ s["X1"][t]) - float(logs)
            g += s["X1"][t] - (u * s1 - v * d1)
            h -= u * s["S2"][t] - v * s["D2"][t] - (uu * np.outer(s1, s1) - uv * (cross + cross.T) + vv * np.outer(d1, d1))
    return ll, g, h


def _baseline(sums) -> list[tuple]:
    """Breslow's cumulative hazard and what else ``CoxModel.baseline`` holds."""
    rows = []
    for s, v in sums.items():
        hazard = var = 0.0
        for t in range(len(v["day"]) - 1, -1, -1):
            hazard += v["d"][t] / v["S0"][t]
            var += v["d"][t] / float(v["n"][t]) ** 2
            rows.append((s, int(v["day"][t]), float(hazard), float(v["d"][t]), float(var), int(v["n"][t])))
    return rows


def with_baseline(model: CoxModel, matrix: DataFrame) -> CoxModel:
    """The model with the baseline hazard of these rows, given its coefficients."""
    scaled = [b * s for b, s in zip(model.beta, model.sd)]
    return replace(model, baseline=_baseline(_sums(matrix, model.columns, model.mean, model.sd, scaled, model.strata)))


def cox_fit(matrix: DataFrame, specs: list[FeatureSpec], cfg: SurvivalConfig = SurvivalConfig(), strata: str | None = None, steps: int = 25) -> CoxModel:
    """Newton with step halving; a stratum column's own dummies are left out."""
    import numpy as np

    columns = predictor_columns([s for s in specs if s.name != strata])
    if not columns:
        raise CoxFailure("no covariates")
    row = matrix.agg(
        F.count("*"), F.sum("event"), *(F.avg(f"`{c}`") for c in columns), *(F.stddev_samp(F.col(f"`{c}`")) for c in columns)
    ).first()
    n, events, p = row[0], row[1] or 0, len(columns)
    if not events:
        raise CoxFailure("no events")
    mean, sd = [float(v) for v in row[2 : 2 + p]], [float(v or 0) for v in row[2 + p :]]
    if min(sd) <= 0 or any(math.isnan(v) for v in sd):
        raise CoxFailure("a covariate doesn't vary")
    ridge, beta, before = cfg.penalizer, np.zeros(p), None
    value = lambda ll, b: ll / n - 0.5 * ridge * float(b @ b)
    sums = _sums(matrix, columns, mean, sd, beta, strata)
    ll, g, h = _likelihood(sums, beta)
    for _ in range(steps):
        before = value(ll, beta)
        try:
            step = np.linalg.solve(-(h / n - ridge * np.eye(p)), g / n - ridge * beta)
        except np.linalg.LinAlgError as x:
            raise CoxFailure("singular Hessian") from x
        size = 1.0
        while True:
            new = beta + size * step
            sums = _sums(matrix, columns, mean, sd, new, strata)
            ll, g, h = _likelihood(sums, new)
            if value(ll, new) >= before - 1e-12 or size < 1e-3:
                break
            size /= 2
        beta = new
        if float(np.abs(size * step).max()) < 1e-8:
            break
    sd_a = np.array(sd)
    cov = np.linalg.inv(-(h - n * ridge * np.eye(p))) / np.outer(sd_a, sd_a)
    return CoxModel(columns, (beta / sd_a).tolist(), mean, sd, cov.tolist(), n, int(events), strata, _baseline(sums))


def hazard_ratios(spark: SparkSession, model: CoxModel) -> DataFrame:
    """``(column, coefficient, hazard_ratio, lo, hi, p, sentence)``."""
    rows = []
    for i, c in enumerate(model.columns):
        b, se = model.beta[i], math.sqrt(model.cov[i][i])
        way = "raises" if b > 0 else "lowers"
        text = f"{c} {way} the hazard of churn by a factor of {math.exp(b):.4g} for each unit."
        rows.append((c, b, math.exp(b), math.exp(b - 1.96 * se), math.exp(b + 1.96 * se), normal_p(b / se), text))
    return spark.createDataFrame(rows, "column string, coefficient double, hazard_ratio double, lo double, hi double, p double, sentence string")


def ph_test(model: CoxModel, matrix: DataFrame) -> dict[str, float]:
    """p for each column: scaled Schoenfeld residuals against average ranks of the event times, all from daily sums."""
    import numpy as np

    beta_std = np.array(model.beta) * np.array(model.sd)
    sums = _sums(matrix, model.columns, model.mean, model.sd, beta_std, model.strata)
    cov = np.array(model.cov) * np.outer(model.sd, model.sd)
    total = sum(s["d"].sum() for s in sums.values())
    at_day: dict[int, float] = {}
    for s in sums.values():
        for day, d in zip(s["day"], s["d"]):
            at_day[int(day)] = at_day.get(int(day), 0.0) + d
    rank, before = {}, 0.0
    for day in sorted(at_day):
        rank[day] = before + (at_day[day] + 1) / 2
        before += at_day[day]
    p = len(model.columns)
    sx, sxx, sxg, sg, sgg = np.zeros(p), np.zeros(p), np.zeros(p), 0.0, 0.0
    for s in sums.values():
        for t in np.flatnonzero(s["d"] > 0):
            d, e, g = s["d"][t], s["S1"][t] / s["S0"][t], rank[int(s["day"][t])]
            r1 = s["X1"][t] - d * e
            r2 = s["X2"][t] - np.outer(e, s["X1"][t]) - np.outer(s["X1"][t], e) + d * np.outer(e, e)
            v1 = total * cov @ r1
            v2 = total**2 * np.einsum("ij,jk,ik->i", cov, r2, cov)
            sx, sxx, sxg = sx + v1, sxx + v2, sxg + v1 * g
            sg, sgg = sg + d * g, sgg + d * g * g
    out = {}
    for j, c in enumerate(model.columns):
        num = sxg[j] - sx[j] * sg / total
        den = (sxx[j] - sx[j] ** 2 / total) * (sgg - sg**2 / total)
        r = num / math.sqrt(den) if den > 0 else 0.0
        t = r * math.sqrt((total - 2) / max(1e-15, 1 - r * r)) if total > 2 else 0.0
        out[c] = float(t_p(t, total - 2)) if total > 2 else 1.0
    return out


def ph_severity(p: dict[str, float], cfg: SurvivalConfig = SurvivalConfig()) -> str:
    """``serious``, ``minor`` or ``none``, by the smallest p."""
    least = min(p.values(), default=1.0)
    return "serious" if least < cfg.ph_serious else "minor" if least < cfg.ph_minor else "none"


def model_status(eligible: bool, decision: str, severity: str, warned: bool, tables: bool) -> str:
    """READY or WARNING where a Cox model stands, else FALLBACK on life tables; without them FAILED, or INSUFFICIENT_DATA
    where no gate was passed."""
    if eligible and decision != "fallback":
        return "WARNING" if warned or severity == "minor" or decision == "stratify" else "READY"
    if tables:
        return "FALLBACK"
    return "FAILED" if eligible else "INSUFFICIENT_DATA"


def ph_decision(model: CoxModel, matrix: DataFrame, specs: list[FeatureSpec], cfg: SurvivalConfig = SurvivalConfig()) -> tuple[str, CoxModel | None, dict[str, float]]:
    """``keep``, ``stratify`` (with the new model) or ``fallback``: a serious violation is refitted by its worst category."""
    p = ph_test(model, matrix)
    if min(p.values()) >= cfg.ph_serious:
        return "keep", model, p
    categories = [s for s in specs if s.kind == "categorical" and len(s.levels) > 1]
    if not categories:
        return "fallback", None, p
    worst = min(categories, key=lambda s: min((p.get(c, 1.0) for c in s.columns), default=1.0))
    if min(p.get(c, 1.0) for c in worst.columns) >= cfg.ph_serious:
        worst = categories[0]
    try:
        again = cox_fit(matrix, specs, cfg, strata=worst.name)
    except CoxFailure:
        return "fallback", None, p
    p2 = ph_test(again, matrix)
    return ("stratify", again, p2) if min(p2.values()) >= cfg.ph_serious else ("fallback", None, p2)


# --- scoring -----------------------------------------------------------------------------------------------


def _hazard_at(model: CoxModel, day: float, index: int = 2) -> Column:
    """The baseline's column ``index`` at a day, by stratum, as a literal."""
    at: dict[str, float] = {}
    for row in model.baseline:
        at.setdefault(row[0], 0.0)
        if row[1] <= day:
            at[row[0]] = row[index]
    if not model.strata:
        return F.lit(at.get("all", 0.0))
    out = F.lit(None).cast("double")
    for s, h in at.items():
        out = F.when(F.col(f"`{model.strata}__raw`") == s, F.lit(h)).otherwise(out)
    return out


def cox_scores(model: CoxModel, matrix: DataFrame, horizons: list[int], median_tenure: float) -> DataFrame:
    """``(customer_id, risk_score, relative_log_hazard, survival_<h>d...)``; risk at 90 days if available, else the median."""
    lp = model.linear()
    at = lambda day: clip(F.exp(-_hazard_at(model, day) * F.exp(lp)))
    reference = 90 if 90 in horizons else median_tenure
    return matrix.select(
        "customer_id", clip(1 - at(reference)).alias("risk_score"), lp.alias("relative_log_hazard"), *(at(h).alias(f"survival_{h}d") for h in horizons)
    )


def cox_interval(model: CoxModel, matrix: DataFrame, day: int) -> DataFrame:
    """``(customer_id, survival, lo, hi)``: an approximate log-log band; the covariates enter uncentred."""
    s = clip(F.exp(-_hazard_at(model, day) * F.exp(model.linear())))
    h, v = _hazard_at(model, day), _hazard_at(model, day, 4)
    quad = F.lit(0.0)
    for i, a in enumerate(model.columns):
        for j, b in enumerate(model.columns):
            quad = quad + F.col(f"`{a}`") * F.col(f"`{b}`") * model.cov[i][j]
    crude: dict[str, float] = {}
    for row in model.baseline:
        if row[1] <= day:
            crude[row[0]] = crude.get(row[0], 0.0) + row[3] / row[5]
    na = F.lit(crude.get("all")) if not model.strata else F.coalesce(*(F.when(F.col(f"`{model.strata}__raw`") == k, F.lit(c)) for k, c in crude.items()))
    width = 1.96 * F.sqrt(F.greatest(F.lit(0.0), F.try_divide(v, na * na) + quad))
    ok = (s > 0) & (s < 1) & (h > 0)
    safe = F.when(ok, s)
    return matrix.select("customer_id", s.alias("survival"), F.pow(safe, F.exp(width)).alias("lo"), F.pow(safe, F.exp(-width)).alias("hi"))


def cox_forward(model: CoxModel, matrix: DataFrame, table: DataFrame, days: int) -> DataFrame:
    """``(customer_id, forward, lo, hi)`` of active rows within follow-up; the band is Greenwood's of the global table."""
    spark = matrix.sparkSession
    raw = F.col(f"`{model.strata}__raw`") if model.strata else F.lit("all")
    base = spark.createDataFrame([(r[0], r[1], 0.0, r[2]) for r in model.baseline], "stratum string, duration long, survival double, greenwood double")
    longest = max(r[1] for r in model.baseline)
    active = matrix.where("event = 0").where(F.col("duration") + days <= longest).withColumn("stratum", raw)
    starts = active.select("stratum", "duration").distinct()
    points = starts.select("stratum", F.explode(F.array("duration", F.col("duration") + days)).alias("day")).distinct()
    at = as_of(points, base).select("stratum", "day", F.col("greenwood").alias("h"))
    now = at.select("stratum", F.col("day").alias("duration"), F.col("h").alias("h0"))
    then = at.select("stratum", (F.col("day") - days).alias("duration"), F.col("h").alias("h1"))
    band = km_forward(matrix.withColumn("stratum", F.lit("all")), table, days).select("customer_id", F.col("forward").alias("_km"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    rows = active.join(now, ["stratum", "duration"]).join(then, ["stratum", "duration"])
    forward = clip(F.exp(-(F.col("h1") - F.col("h0")) * F.exp(model.linear())))
    scored = rows.select("customer_id", forward.alias("forward")).join(band, "customer_id", "left")
    shift = lambda c: clip(F.col("forward") + (F.col(c) - F.col("_km")))
    return scored.select("customer_id", "forward", shift("_lo").alias("lo"), shift("_hi").alias("hi"))


def contributions(model: CoxModel, matrix: DataFrame, specs: list[FeatureSpec]) -> DataFrame:
    """``(customer_id, contributions)``: one struct for each term; with the baseline they add up to the log hazard."""
    parts = []
    for s in specs:
        for c in s.columns:
            if c not in model.columns:
                continue
            i = model.columns.index(c)
            b, se = model.beta[i], math.sqrt(model.cov[i][i])
            reliable = b - 1.96 * se > 0 or b + 1.96 * se < 0
            value = F.col(f"`{c}`")
            contribution = b * (value - model.mean[i]) if s.kind == "numeric" else b * value
            reference = f"{model.mean[i]:.4g}" if s.kind == "numeric" else s.levels[0]
            parts.append(
                F.struct(
                    F.lit(s.name).alias("feature"), F.lit(c).alias("column"), F.lit(s.kind).alias("kind"), value.alias("value"), F.lit(reference).alias("reference"),
                    F.lit(b).alias("coefficient"), F.lit(math.exp(b)).alias("hazard_ratio"), contribution.alias("contribution"), F.lit(reliable).alias("reliable"),
                )
            )
    kept = F.filter(F.array(*parts), lambda c: (c["kind"] == "numeric") | (c["value"] != 0))
    return matrix.select("customer_id", kept.alias("contributions"))


def baseline_log_hazard(model: CoxModel, specs: list[FeatureSpec]) -> float:
    """What the centred linear predictor takes off for categories: sum of coefficient x mean of their columns."""
    numeric = {s.name for s in specs if s.kind == "numeric"}
    return -sum(b * m for c, b, m in zip(model.columns, model.beta, model.mean) if c not in numeric)


def contribution_text(c: Column) -> Column:
    side = F.when(c["contribution"] > 0, "raises").otherwise("lowers")
    where = F.when(c["kind"] == "categorical", F.concat(F.lit("is "), c["column"])).otherwise(
        F.concat(F.when(c["value"] > c["reference"].try_cast("double"), "is above").otherwise("is at or below"), F.lit(" the reference "), c["reference"])
    )
    return F.concat(c["feature"], F.lit(" "), where, F.lit(" and "), side, F.lit(" the hazard (hazard ratio "), F.format_string("%.4g", c["hazard_ratio"]), F.lit(")."))


# --- concordance -------------------------------------------------------------------------------------------


def _in_buckets(df: DataFrame, bucket_rows: int, most: int) -> DataFrame:
    """``df`` with ``bucket``: ranges of the score that hold about ``bucket_rows`` rows, or one score. Rows without score or
    duration are left out."""
    from pyspark.ml.feature import Bucketizer

    rows = df.where(F.col("duration").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score")).withColumn("score", F.col("score").cast("double"))
    k = max(1, min(most, rows.count() // bucket_rows))
    bounds = sorted(set(rows.approxQuantile("score", [i / k for i in range(1, k)], 0.1 / k))) if k > 1 else []
    if not bounds:
        return rows.withColumn("bucket", F.lit(0))
    # a bound's own score starts a bucket, and the next larger number ends it, so that a frequent score stands alone
    edges = sorted({e for b in bounds for e in (b, math.nextafter(b, math.inf))} - {math.inf})
    cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="score", outputCol="_bucket")
    return cut.transform(rows).withColumn("bucket", F.col("_bucket").cast("int")).drop("_bucket")


def c_index(df: DataFrame, bucket_rows: int = 20_000) -> DataFrame:
    """One row ``(concordant, tied, pairs, c_index)`` from ``(duration, event, score)``, higher scores failing sooner.

    Equal rows are counted first. Pairs across score buckets follow from running counts of (bucket, day) cells;
    pairs within a bucket are counted by merging, in its own task. Rows without score or duration are left out.
    """
    from pyspark.sql import Window

    cells = _in_buckets(df, bucket_rows, 10_000).groupBy("bucket", "score", "duration", "event").agg(F.count("*").alias("n"))
    cells = write_and_read(cells, "concordance")
    grid = cells.groupBy("bucket", "duration").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("event") == 1, F.col("n")).otherwise(0)).alias("e"))
    days = grid.select("duration").distinct()
    full = grid.select("bucket").distinct().crossJoin(days).join(grid, ["bucket", "duration"], "left").fillna(0, ["n", "e"])  # buckets x days of counts
    later = Window.partitionBy("bucket").orderBy(F.desc("duration"))
    full = full.withColumn("after", F.sum("n").over(later) - F.col("e"))  # outlive an event of this day
    order = Window.partitionBy("duration").orderBy("bucket")
    full = full.withColumn("below", F.sum("after").over(order) - F.col("after")).withColumn("all", F.sum("after").over(Window.partitionBy("duration")))
    cross = full.agg(
        F.coalesce(F.sum(F.col("e") * F.col("below")), F.lit(0)).alias("concordant"),
        F.coalesce(F.sum(F.col("e") * F.col("all")), F.lit(0)).alias("pairs"),
    )

    def inside(pdf):
        import pandas as pd

        pdf = pdf.sort_values("score")
        good, tied = concordance_inside(*_keyed(pdf), pdf.n.to_numpy())
        return pd.DataFrame({"concordant": [good], "tied": [tied]})

    own = cells.groupBy("bucket").applyInPandas(inside, "concordant long, tied long")
    both = own.select("concordant", "tied", F.lit(0).alias("pairs")).union(cross.select("concordant", F.lit(0), "pairs"))
    one = both.agg(*(F.sum(c).alias(c) for c in ("concordant", "tied", "pairs")))
    return one.withColumn("c_index", F.try_divide(F.col("concordant") + 0.5 * F.col("tied"), F.col("pairs")))


def _keyed(pdf):
    """Keys (twice the day's number, plus 1 where no event is seen) and scores: a cell outlives an event if its key is larger."""
    import numpy as np

    return 2 * np.unique(pdf.duration, return_inverse=True)[1] + (pdf.event.to_numpy() != 1), pdf.score.to_numpy()


def concordance_inside(key, score, n):
    """Concordant and tied pairs among cells sorted by score, with the keys of ``_keyed``.

    ``n`` counts each cell once, or has a column for each round; the results have its last shape. Halves of the scores
    are counted against each other by running sums over keys, then each by itself.
    """
    import numpy as np

    n = np.asarray(n)

    def against(low, high):
        order = np.argsort(key[low], kind="stable")
        left = np.concatenate([np.cumsum(n[low][order][::-1], 0)[::-1], np.zeros((1, *n.shape[1:]), n.dtype)])
        hit = key[high] % 2 == 0
        return (n[high][hit] * left[np.searchsorted(key[low][order], key[high][hit], side="right")]).sum(0)

    starts = np.concatenate([[0], np.flatnonzero(np.diff(score)) + 1, [len(score)]])
    good, tied, waiting = np.zeros(n.shape[1:], n.dtype), np.zeros(n.shape[1:], n.dtype), [(0, len(starts) - 1)]
    while waiting:
        a, b = waiting.pop()
        if b - a == 1:
            one = slice(starts[a], starts[b])
            if starts[b] - starts[a] > 1:
                tied = tied + against(one, one)
        elif b > a:
            m = (a + b) // 2
            good = good + against(slice(starts[a], starts[m]), slice(starts[m], starts[b]))
            waiting += [(a, m), (m, b)]
    return good, tied


def c_index_bootstrap(df: DataFrame, rounds: int = 200, seed: int = 7, bucket_rows: int = 20_000) -> DataFrame:
    """One row ``(lo, hi)``: percentiles over rounds of Poisson weights hashed from (seed, round, id), on exact scores.

    A row is shuffled once, to its score bucket; its weights in all rounds are drawn there. One merge counts the pairs of
    a bucket for all rounds. Pairs across buckets follow from each bucket's counts by day, which go on round by round.
    A bucket over four times ``bucket_rows`` is one frequent score: its rows are first added up by day in parts.
    """
    buckets = write_and_read(_in_buckets(df.select("customer_id", "duration", "event", "score"), bucket_rows, 1_000), "bootstrap")
    parts = buckets.groupBy("bucket").agg(F.ceil(F.count("*") / (4 * bucket_rows)).cast("int").alias("parts"))
    placed = buckets.join(F.broadcast(parts), "bucket")  # 2,000 rows at most
    placed = placed.withColumn("part", F.pmod(F.xxhash64("customer_id"), F.col("parts")).cast("int"))
    draws = F.transform(F.sequence(F.lit(1), F.lit(rounds)), lambda r: F.pmod(F.xxhash64(F.lit(seed), r, "customer_id"), F.lit(1 << 30)).cast("int"))
    drawn = placed.repartition("bucket", "part").withColumn("draws", draws)
    limits, total = [], 0.0
    for j in range(8):
        total += math.exp(-1) / math.factorial(j)
        limits.append(total)

    def weights(pdf):
        import numpy as np

        return np.searchsorted(limits, np.stack(pdf.draws.to_numpy()) / float(1 << 30), side="right").astype(np.float64)

    def counted(bucket, pdf, w):
        """A row for each round: the pairs of the bucket, and its counts by day and event."""
        import numpy as np
        import pandas as pd

        good, tied = concordance_inside(*_keyed(pdf), w)
        days, at = np.unique(pdf.duration, return_inverse=True)
        grid = np.zeros((2, len(days), rounds))
        np.add.at(grid, ((pdf.event.to_numpy() == 1).astype(int), at), w)
        packed = [grid[:, :, r].tobytes() for r in range(rounds)]
        return pd.DataFrame(
            {"round": range(1, rounds + 1), "bucket": bucket, "good": good + 0.5 * tied, "days": [days.astype(np.float64).tobytes()] * rounds, "grid": packed}
        )

    def whole(pdf):
        pdf = pdf.sort_values("score")
        return counted(int(pdf.bucket.iloc[0]), pdf, weights(pdf))

    def added(pdf):
        import numpy as np
        import pandas as pd

        cells, at = np.unique(pdf[["score", "duration", "event"]].to_numpy(np.float64), axis=0, return_inverse=True)
        w = np.zeros((len(cells), rounds))
        np.add.at(w, at.ravel(), weights(pdf))
        return pd.DataFrame({"bucket": pdf.bucket.iloc[0], "score": cells[:, 0], "duration": cells[:, 1], "event": cells[:, 2].astype(int), "w": list(w)})

    def joined(pdf):
        import numpy as np

        pdf = pdf.sort_values("score")
        return counted(int(pdf.bucket.iloc[0]), pdf, np.stack(pdf.w.to_numpy()))

    def across(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("bucket")
        days = [np.frombuffer(d) for d in pdf.days]
        every = np.unique(np.concatenate(days))
        good = pairs = 0.0
        below, events = np.zeros(len(every)), np.zeros(len(every))
        for own, packed in zip(days, pdf.grid):
            spread = np.zeros((2, len(every)))
            spread[:, np.searchsorted(every, own)] = np.frombuffer(packed).reshape(2, -1)
            after = np.cumsum(spread.sum(0)[::-1])[::-1] - spread[1]
            good += (spread[1] * below).sum()
            below += after
            events += spread[1]
        pairs = (events * below).sum()
        return pd.DataFrame({"c": [(good + pdf.good.sum()) / pairs if pairs else None]})

    schema = "round int, bucket int, good double, days binary, grid binary"
    cold = drawn.where("parts = 1").groupBy("bucket", "part").applyInPandas(whole, schema)
    frequent = drawn.where("parts > 1").groupBy("bucket", "part").applyInPandas(added, "bucket int, score double, duration double, event int, w array<double>")
    sums = cold.union(frequent.groupBy("bucket").applyInPandas(joined, schema))
    values = sums.groupBy("round").applyInPandas(across, "c double")
    return values.agg(F.percentile("c", 0.025).alias("lo"), F.percentile("c", 0.975).alias("hi"))


# --- the whole model ---------------------------------------------------------------------------------------


@dataclass
class SurvivalModel:
    status: str
    specs: list[FeatureSpec]
    cox: CoxModel | None
    horizons: list[int]
    segment: str | None
    warnings: list[str]
    median_tenure: float
    life_tables: DataFrame | None = None
    #: Concordance of the delivered scores, and its resampling interval.
    c_index: float | None = None
    c_interval: tuple[float, float] | None = None


def fit_survival(df: DataFrame, predictors: list[str], cfg: SurvivalConfig = SurvivalConfig()) -> SurvivalModel:
    """States, matrix, gates, life tables, Cox, its assumptions and its concordance; a failed Cox falls back to life tables.

    The concordance ranks by the risk score that is delivered (strata have their own baselines), which is the order of
    the linear predictor where there are none.
    """
    states = customer_states(df, predictors, cfg)
    scored = write_and_read(states.where("state = 'SCORED'"), "scored")
    specs = feature_specs(scored, predictors, cfg)
    matrix = write_and_read(design_matrix(scored, specs), "matrix")  # every step of the fit reads it
    n_input = df.count()
    blocked = [r.gate for r in eligibility(matrix, specs, max(1, n_input), cfg).collect() if not r.ok]
    median = matrix.agg(F.percentile("duration", 0.5)).first()[0]
    if median is None:  # nobody to score, so no life table either
        return SurvivalModel("INSUFFICIENT_DATA", specs, None, [], None, blocked, 0.0)
    raised = [r.warning for r in eligibility_warnings(matrix, n_input, cfg).collect() if r.raised]
    columns = predictor_columns(specs)
    raised += [f"collinear {r.a} {r.b}" for r in collinear_pairs(matrix, columns, cfg.correlation_threshold).collect()] if len(columns) > 1 and not blocked else []
    if len(columns) >= cfg.vif_min_predictors and not blocked:
        raised += [f"vif {c}" for c, v in variance_inflation(matrix, columns).items() if v > cfg.vif_threshold]
    segment = km_segment(matrix, specs, cfg)
    table = km_table(matrix)
    tables = table.union(km_table(matrix, f"{segment}__raw")) if segment else table
    horizons = [r.horizon for r in horizon_status(matrix, table, cfg).collect() if r.available]
    decision, model, severity = "fallback", None, "none"
    if blocked:
        raised += blocked
    else:
        try:
            model = cox_fit(matrix, specs, cfg)
            severity = ph_severity(ph_test(model, matrix), cfg)
            decision, model, _ = ph_decision(model, matrix, specs, cfg)
        except CoxFailure as x:
            decision, model = "fallback", None
            raised.append(str(x))
    status = model_status(not blocked, decision, severity, bool(raised), table is not None)
    fitted = SurvivalModel(status, specs, model, horizons, segment, raised, float(median), tables)
    if model:
        risk = cox_scores(model, matrix, horizons or [90], float(median)) if model.strata else matrix.select("customer_id", model.linear().alias("risk_score"))
        ranked = write_and_read(matrix.select("customer_id", "duration", "event").join(risk.select("customer_id", F.col("risk_score").alias("score")), "customer_id"), "ranked")
        fitted.c_index = c_index(ranked.drop("customer_id")).first().c_index
        if cfg.bootstrap > 1:
            fitted.c_interval = tuple(c_index_bootstrap(ranked, cfg.bootstrap).first())
    return fitted


def score_survival(model: SurvivalModel, df: DataFrame, predictors: list[str], cfg: SurvivalConfig = SurvivalConfig()) -> DataFrame:
    """``(customer_id, state, risk_score, survival_90d, forward_90d)`` for every row; NULL where the model says nothing."""
    states = customer_states(df, predictors, cfg)
    out = states.select("customer_id", "state")
    null = F.lit(None).cast("double")
    if model.life_tables is None:
        return out.select("*", null.alias("risk_score"), null.alias("survival_90d"), null.alias("forward_90d"))
    matrix = design_matrix(states.where("state = 'SCORED'"), model.specs)
    table = model.life_tables.where("stratum = 'all'")
    if model.cox:
        scores = cox_scores(model.cox, matrix, model.horizons or [90], model.median_tenure)
        risk = scores.select("customer_id", "risk_score", F.col("survival_90d") if "survival_90d" in scores.columns else null.alias("survival_90d"))
        forward = cox_forward(model.cox, matrix, table, 90)
    else:
        by = model.segment
        at = km_survival_at(model.life_tables.where("stratum != 'all'") if by else table, (90,)).select("stratum", F.col("survival").alias("survival_90d"))
        raw = F.col(f"`{by}__raw`") if by else F.lit("all")
        risk = matrix.select("customer_id", raw.alias("stratum")).join(at, "stratum").select("customer_id", (1 - F.col("survival_90d")).alias("risk_score"), "survival_90d")
        forward = km_forward(matrix.withColumn("stratum", F.lit("all")), table, 90)
    return out.join(risk, "customer_id", "left").join(forward.select("customer_id", F.col("forward").alias("forward_90d")), "customer_id", "left")


def dataset_version(df: DataFrame, config: str = "") -> str:
    """A fingerprint that no order of rows changes: count, sum and exclusive or of row hashes, with the config."""
    h = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    row = df.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first()
    from hashlib import sha256

    return sha256(f"{sorted(df.columns)}|{row[0]}|{row[1]}|{row[2]}|{config}".encode()).hexdigest()


def save_model(model: CoxModel, spark: SparkSession, folder: str) -> str:
    """The model as one JSON line and its digest, written by Spark; returns the digest."""
    from hashlib import sha256

    body = json.dumps(model.__dict__, sort_keys=True)
    digest = sha256(body.encode()).hexdigest()
    spark.createDataFrame([(body, digest)], "body string, digest string").coalesce(1).write.mode("overwrite").parquet(folder)
    return digest


def load_model(spark: SparkSession, folder: str) -> CoxModel:
    """Refuses a model whose digest is missing or wrong."""
    from hashlib import sha256

    row = spark.read.parquet(folder).first()
    if row is None or not row.digest or sha256(row.body.encode()).hexdigest() != row.digest:
        raise ValueError("the model's digest doesn't fit")
    d = json.loads(row.body)
    d["baseline"] = [tuple(r) for r in d["baseline"]]
    return CoxModel(**d)


def ph_preview(matrix_of, features: list[str], cfg: SurvivalConfig = SurvivalConfig()) -> dict[str, float | None]:
    """Smallest p of a one-feature fit; None below the least events or where nothing can be fitted.

    ``matrix_of(feature)`` gives the feature's ``(matrix, specs)``.
    """
    out: dict[str, float | None] = {}
    for f in features:
        matrix, specs = matrix_of(f)
        events = matrix.agg(F.sum("event")).first()[0] or 0
        try:
            if events < cfg.min_events:
                raise CoxFailure("few events")
            out[f] = min(ph_test(cox_fit(matrix, specs, cfg), matrix).values())
        except CoxFailure:
            out[f] = None
    return out
