"""Queries of the Cox model, of what follows from it, and of files."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.files import new_folder, write_and_read
from ..operators import cox as C
from ..operators import survival as M
from ..sources import tables as T
from .survival import FORWARD, PREDICTORS, STATES, flat_accounts, matrix_of, rounded
from .views import view

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
CFG = M.SurvivalConfig(min_customers=20, min_events=5, min_events_per_predictor=1.0)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def fitted(spark, sf_dir):
    matrix, specs = matrix_of(spark, sf_dir)
    matrix = write_and_read(matrix, "matrix")  # every step of a fit reads it
    return C.cox_fit(matrix, specs, CFG), matrix, specs


# A model as it might come from elsewhere, so that SQL can follow what is computed with it: coefficient, mean and
# variance of the coefficient. The baseline is that of the rows.
GIVEN = {
    "plan_tier_BUILDING": (0.3, 0.2, 0.01),
    "plan_tier_FURNITURE": (-0.2, 0.2, 0.02),
    "plan_tier_HOUSEHOLD": (0.05, 0.2, 0.01),
    "plan_tier_MACHINERY": (-0.4, 0.2, 0.03),
    "contract_length_months": (-0.02, 12.0, 0.0001),
    "usage_frequency": (-0.06, 10.0, 0.0004),
}


def given(spark, sf_dir):
    """The model of GIVEN with the baseline of the accounts, and their matrix."""
    matrix, specs = matrix_of(spark, sf_dir)
    matrix = write_and_read(matrix, "matrix")
    columns = [c for c in M.predictor_columns(specs) if c in GIVEN]
    beta, mean, variance = ([GIVEN[c][k] for c in columns] for k in range(3))
    cov = [[variance[i] if i == j else 0.0 for j in range(len(columns))] for i in range(len(columns))]
    n, events = matrix.agg(F.count("*"), F.coalesce(F.sum("event"), F.lit(0))).first()
    model = C.CoxModel(columns, beta, mean, [1.0] * len(columns), cov, n, events)
    return C.with_baseline(model, matrix), matrix, specs


_SHORT = {"plan_tier_BUILDING": "b", "plan_tier_FURNITURE": "f", "plan_tier_HOUSEHOLD": "h", "plan_tier_MACHINERY": "m"}
_LINEAR = " + ".join(f"({_SHORT.get(c, c)} - {m}) * ({b})" for c, (b, m, _) in GIVEN.items())
_QUAD = " + ".join(f"pow({_SHORT.get(c, c)}, 2) * {v}" for c, (_, _, v) in GIVEN.items())
#: DuckDB: log hazards by GIVEN, Breslow's baseline, and its value at a day.
HAZARDS = f""", lp AS (SELECT *, {_LINEAR} AS eta, {_QUAD} AS quad FROM matrix),
  by_day AS (SELECT duration, sum(exp(eta)) AS w, count(*) AS n, sum(event) AS d FROM lp GROUP BY duration),
  at_risk AS (SELECT duration, d, sum(w) OVER (ORDER BY duration DESC) AS s0, sum(n) OVER (ORDER BY duration DESC) AS n FROM by_day),
  base AS (SELECT duration, sum(d / s0) OVER w AS hz, sum(d / (n * n)) OVER w AS vr, sum(d / n) OVER w AS crude FROM at_risk WINDOW w AS (ORDER BY duration))
"""


def _at(day, column: str = "hz") -> str:
    return f"coalesce((SELECT max_by({column}, duration) FROM base WHERE duration <= {day}), 0)"


def _clip(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


@query()
def cox_fit(spark, sf_dir):
    """Coefficients of the plain fit and of the fit stratified by plan tier."""
    plain, matrix, specs = fitted(spark, sf_dir)
    models = (plain, C.cox_fit(matrix, specs, CFG, strata="plan_tier"))
    rows = [
        (m.strata, c, beta, mean, sd, m.n, m.n_events)
        for m in models
        for c, beta, mean, sd in zip(m.columns, m.beta, m.mean, m.sd)
    ]
    return spark.createDataFrame(rows, "strata string, column string, coefficient double, mean double, sd double, n long, n_events long")


@query()
def hazard_ratios(spark, sf_dir):
    return C.hazard_ratios(spark, fitted(spark, sf_dir)[0])


@query()
def ph_test(spark, sf_dir):
    model, matrix, _ = fitted(spark, sf_dir)
    return spark.createDataFrame(sorted(C.ph_test(model, matrix).items()), "column string, p double")


@query()
def ph_decision(spark, sf_dir):
    model, matrix, specs = fitted(spark, sf_dir)
    decision, again, p = C.ph_decision(model, matrix, specs, CFG)
    strata = again.strata if again else None
    return spark.createDataFrame([(decision, strata, min(p.values()))], "decision string, strata string, least_p double")


@query()
def variance_inflation(spark, sf_dir):
    matrix, specs = matrix_of(spark, sf_dir)
    return spark.createDataFrame(sorted(M.variance_inflation(matrix, M.predictor_columns(specs)).items()), "column string, vif double")


SCORED = """, s AS (SELECT duration, event, -usage_frequency AS score FROM matrix),
  p AS (SELECT a.score AS x, b.score AS y FROM s a JOIN s b ON a.event = 1 AND (b.duration > a.duration OR (b.duration = a.duration AND b.event = 0)))"""


@query(
    STATES
    + SCORED
    + " SELECT sum((x > y)::INT) AS concordant, sum((x = y)::INT) AS tied, count(*) AS pairs, round((sum((x > y)::INT) + 0.5 * sum((x = y)::INT)) / count(*), 6) AS c_index FROM p"
)
def c_index(spark, sf_dir):
    m = matrix_of(spark, sf_dir)[0].select("duration", "event", (-F.col("usage_frequency")).alias("score"))
    return rounded(C.c_index(m, bucket_rows=100), c_index=6)


@query()
def c_index_bootstrap(spark, sf_dir):
    m = matrix_of(spark, sf_dir)[0].select("customer_id", "duration", "event", (-F.col("usage_frequency")).alias("score"))
    return C.c_index_bootstrap(m, rounds=CFG.bootstrap)


def _survival(day) -> str:
    return _clip(f"exp(-{_at(day)} * exp(eta))")


@query(
    STATES
    + HAZARDS
    + f"""SELECT customer_id, round({_clip(f'1 - {_survival(90)}')}, 6) AS risk_score, round(eta, 6) AS relative_log_hazard, round({_survival(30)}, 6) AS survival_30d,
    round({_survival(90)}, 6) AS survival_90d, round({_survival(180)}, 6) AS survival_180d FROM lp"""
)
def cox_scores(spark, sf_dir):
    model, matrix, _ = given(spark, sf_dir)
    scores = C.cox_scores(model, matrix, [30, 90, 180], 90.0)
    return rounded(scores, **{c: 6 for c in scores.columns if c != "customer_id"})


@query(
    STATES
    + HAZARDS
    + f""", s AS (SELECT customer_id, {_survival(180)} AS s, {_at(180)} AS hz, 1.96 * sqrt(greatest(0, {_at(180, 'vr')} / pow({_at(180, 'crude')}, 2) + quad)) AS width FROM lp)
    SELECT customer_id, round(s, 6) AS survival, CASE WHEN s > 0 AND s < 1 AND hz > 0 THEN round(pow(s, exp(width)), 6) END AS lo,
      CASE WHEN s > 0 AND s < 1 AND hz > 0 THEN round(pow(s, exp(-width)), 6) END AS hi FROM s"""
)
def cox_interval(spark, sf_dir):
    model, matrix, _ = given(spark, sf_dir)
    return rounded(C.cox_interval(model, matrix, 180), survival=6, lo=6, hi=6)


@query(
    FORWARD
    + HAZARDS
    + f""", g0 AS (SELECT customer_id, eta, duration AS d0, duration + 90 AS d1 FROM lp WHERE event = 0 AND duration + 90 <= (SELECT max(duration) FROM base)),
    g1 AS (SELECT g0.*, coalesce(base.hz, 0) AS h0 FROM g0 ASOF LEFT JOIN base ON g0.d0 >= base.duration),
    g2 AS (SELECT customer_id, {_clip('exp(-(coalesce(base.hz, 0) - h0) * exp(eta))')} AS fw FROM g1 ASOF LEFT JOIN base ON g1.d1 >= base.duration)
    SELECT customer_id, round(fw, 6) AS forward, CASE WHEN lo IS NOT NULL THEN round({_clip('fw + lo - forward')}, 6) END AS lo,
      CASE WHEN hi IS NOT NULL THEN round({_clip('fw + hi - forward')}, 6) END AS hi FROM g2 LEFT JOIN fwd USING (customer_id)"""
)
def cox_forward(spark, sf_dir):
    model, matrix, _ = given(spark, sf_dir)
    return rounded(C.cox_forward(model, matrix, M.km_table(matrix), 90), forward=6, lo=6, hi=6)


def _terms() -> str:
    """Each term of each row in SQL; a model's numbers are written as Java writes them (four digits, zeros kept)."""
    parts = []
    for c, (b, m, v) in GIVEN.items():
        category = c in _SHORT
        x, hr = _SHORT.get(c, c), math.exp(b)
        value = f"{b} * {x}" if category else f"{b} * ({x} - {m})"
        reference = "(SELECT min(plan_tier) FROM matrix)" if category else f"'{m:.4g}'"
        reliable = abs(b) > 1.96 * math.sqrt(v)
        parts.append(
            f"SELECT customer_id, '{'plan_tier' if category else c}' AS feature, '{c}' AS \"column\", '{'categorical' if category else 'numeric'}' AS kind,"
            f" {x} AS value, {reference} AS reference, {b} AS coefficient, {hr!r} AS hazard_ratio, '{hr:#.4g}' AS hr_text, {value} AS contribution, {reliable} AS reliable"
            f" FROM matrix{f' WHERE {x} <> 0' if category else ''}"
        )
    return ", terms AS (" + " UNION ALL ".join(parts) + ") "


@query(
    STATES
    + _terms()
    + """SELECT customer_id, feature, "column", kind, value, reference, CAST(coefficient AS DOUBLE) AS coefficient, round(hazard_ratio, 6) AS hazard_ratio,
    round(contribution, 6) AS contribution, reliable FROM terms"""
)
def contributions(spark, sf_dir):
    model, matrix, specs = given(spark, sf_dir)
    rows = C.contributions(model, matrix, specs).select("customer_id", F.inline("contributions"))
    return rounded(rows, hazard_ratio=6, contribution=6)


@query(
    STATES
    + _terms()
    + """SELECT customer_id, "column", feature || ' ' || CASE WHEN kind = 'categorical' THEN 'is ' || "column" WHEN value > TRY_CAST(reference AS DOUBLE) THEN 'is above the reference ' || reference
      ELSE 'is at or below the reference ' || reference END || ' and ' || CASE WHEN contribution > 0 THEN 'raises' ELSE 'lowers' END || ' the hazard (hazard ratio ' || hr_text || ').' AS sentence FROM terms"""
)
def contribution_text(spark, sf_dir):
    model, matrix, specs = given(spark, sf_dir)
    rows = C.contributions(model, matrix, specs).select("customer_id", F.explode("contributions").alias("c"))
    return rows.select("customer_id", F.col("c.column").alias("column"), C.contribution_text(F.col("c")).alias("sentence"))


@query()
def survival_model(spark, sf_dir):
    df = write_and_read(flat_accounts(spark, sf_dir), "accounts")
    model = C.fit_survival(df, PREDICTORS, CFG)
    low, high = model.c_interval or (None, None)
    added = {"status": F.lit(model.status), "c_index": F.lit(model.c_index), "c_low": F.lit(low), "c_high": F.lit(high)}
    return C.score_survival(model, df, PREDICTORS, CFG).withColumns({k: v.cast("double") if k != "status" else v for k, v in added.items()})


@query()
def ph_preview(spark, sf_dir):
    matrix, specs = matrix_of(spark, sf_dir)
    matrix = write_and_read(matrix, "matrix")
    by = {s.name: s for s in specs}
    found = C.ph_preview(lambda f: (matrix, [by[f]]), PREDICTORS, CFG)
    return spark.createDataFrame(sorted(found.items()), "feature string, p double")


@query()
def dataset_version(spark, sf_dir):
    return spark.createDataFrame([(C.dataset_version(flat_accounts(spark, sf_dir), str(CFG)),)], "version string")


@query()
def save_load_model(spark, sf_dir):
    """Scores by the reloaded model, beside those of the fitted one."""
    model, matrix, _ = fitted(spark, sf_dir)
    folder = new_folder(spark, "model")
    C.save_model(model, spark, folder)
    again = C.load_model(spark, folder)
    a = C.cox_scores(model, matrix, [90], 90.0).select("customer_id", "risk_score")
    b = C.cox_scores(again, matrix, [90], 90.0).select("customer_id", F.col("risk_score").alias("reloaded"))
    return a.join(b, "customer_id")


@query("SELECT c_custkey AS row_id, CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment FROM customer")
def read_customer_table(spark, sf_dir):
    """``customer`` written as CSV, in key order over several files, and read back as text with row ids."""
    path = new_folder(spark, "table") + "/customer.csv"
    view(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").orderBy("c_custkey").write.option("header", True).csv(path)
    return T.read_table(spark, path).select(F.col("_row_id").alias("row_id"), "c_custkey", "c_mktsegment")


@query("SELECT 'conv-' || conv_id AS thread_id, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def read_threads(spark, sf_dir):
    """``conversations`` written as nested JSON threads and read with the fixed schema."""
    path = new_folder(spark, "threads") + "/threads.json"
    rows = view(spark, sf_dir, "conversations")
    nested = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.concat(F.lit("m"), F.col("turn").cast("string")).alias("message_id"), "role", "text"))).alias("messages")
    )
    nested.select(F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("thread_id"), "messages").write.json(path)
    threads = T.read_threads_lines(spark, path)
    return T.flatten_threads(threads)[1].groupBy("thread_id").agg(F.count("*").alias("n_messages"))


@query("SELECT 'accounts' AS table_name, count(*) AS n_rows FROM customer UNION ALL SELECT 'nations', count(*) FROM nation")
def write_outputs(spark, sf_dir):
    folder = new_folder(spark, "outputs")
    return T.write_outputs(folder, accounts=view(spark, sf_dir, "customer"), nations=view(spark, sf_dir, "nation"))
