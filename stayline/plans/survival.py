"""Queries of feature screening and survival tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import screening as SC
from ..operators import survival as M
from ..operators import validate as V
from .canonical import CANON, accepted_accounts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
PREDICTORS = ["plan_tier", "contract_length_months", "usage_frequency"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df, **digits):
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


# --- screening ---------------------------------------------------------------------------------------------

LONG = CANON + """, long AS (
  SELECT customer_id, event_observed AS event, tenure, 'balance' AS feature, balance AS value FROM accepted UNION ALL
  SELECT customer_id, event_observed, tenure, 'region', region FROM accepted UNION ALL
  SELECT customer_id, event_observed, tenure, 'exit_reason', exit_reason FROM accepted UNION ALL
  SELECT customer_id, event_observed, tenure, 'tenure_copy', CAST(CAST(tenure AS BIGINT) AS VARCHAR) FROM accepted),
present AS (SELECT *, trim(value) <> '' AND value IS NOT NULL AS filled, TRY_CAST(value AS DOUBLE) AS x FROM long),
profile AS (SELECT feature, CASE WHEN sum(CASE WHEN filled AND x IS NULL THEN 1 ELSE 0 END) = 0 AND sum(CASE WHEN filled THEN 1 ELSE 0 END) > 0
   THEN 'number' ELSE 'category' END AS kind, count(*) AS n_evaluable, sum(CASE WHEN filled THEN 1 ELSE 0 END) AS n_present,
   coalesce(abs(avg(CASE WHEN event = 1 THEN CASE WHEN filled THEN 1 ELSE 0 END END) - avg(CASE WHEN event = 0 THEN CASE WHEN filled THEN 1 ELSE 0 END END)), 0) AS presence_gap
   FROM present GROUP BY feature),
val AS (SELECT feature, x, count(*) AS n, sum(event) AS e FROM present WHERE x IS NOT NULL GROUP BY 1, 2),
mid AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY x) - n + (n + 1) / 2.0 AS m FROM val),
auc_n AS (SELECT feature, (sum(m * e) - sum(e) * (sum(e) + 1) / 2.0) / nullif(sum(e) * (sum(n) - sum(e)), 0) AS raw FROM mid GROUP BY feature),
lev AS (SELECT feature, value, count(*) AS n, sum(event) AS e FROM present WHERE filled GROUP BY 1, 2),
lx AS (SELECT feature, e / n AS x, sum(n) AS n, sum(e) AS e FROM lev GROUP BY 1, 2),
lmid AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY x) - n + (n + 1) / 2.0 AS m FROM lx),
auc_c AS (SELECT feature, (sum(m * e) - sum(e) * (sum(e) + 1) / 2.0) / nullif(sum(e) * (sum(n) - sum(e)), 0) AS raw FROM lmid GROUP BY feature),
lsize AS (SELECT feature, count(*) AS n_levels, sum(n) AS present FROM lev GROUP BY feature),
lev2 AS (SELECT lev.feature, max(n_levels) AS n_levels, sum(CASE WHEN n >= greatest(20, ceil(present * 0.05)) AND (e = 0 OR e = n) THEN 1 ELSE 0 END) AS n_pure
   FROM lev JOIN lsize USING (feature) GROUP BY lev.feature),
tcorr AS (SELECT feature, corr(x, CASE WHEN x IS NOT NULL THEN tenure END) AS r FROM present GROUP BY feature),
promo AS (SELECT feature, count(*) AS n, sum(CASE WHEN filled THEN 1 ELSE 0 END) AS p, count(DISTINCT CASE WHEN filled THEN value END) AS lv, sum(event) AS ev,
   coalesce(avg(CASE WHEN filled AND (x IS NULL OR x <> 0) THEN event END) - avg(CASE WHEN filled THEN event END), 0) AS association FROM present GROUP BY feature),
promo2 AS (SELECT *, 1 - p / n AS missing_fraction, CASE WHEN 1 - p / n > 0.3 THEN 'missingness' WHEN lv <= 1 THEN 'no variation' WHEN ev < 30 THEN 'sparse events' ELSE 'association' END AS reason FROM promo)
"""


def long_accounts(spark, sf_dir):
    df = accepted_accounts(spark, sf_dir)
    x = F.col("extra_features")
    return SC.long_form(
        df, {"balance": x["balance"], "region": x["region"], "exit_reason": x["exit_reason"], "tenure_copy": F.col("tenure").cast("long")}
    )


def counted_accounts(spark, sf_dir):
    return V.value_counts(long_accounts(spark, sf_dir))


@query(LONG + "SELECT feature, reason = 'association' AS promote, reason, round(missing_fraction, 6) AS missing_fraction, round(association, 6) AS association FROM promo2")
def evaluate_promotion(spark, sf_dir):
    return rounded(V.evaluate_promotion(counted_accounts(spark, sf_dir)), missing_fraction=6, association=6)


@query(
    LONG
    + "SELECT feature, kind, n_evaluable, n_present, round(1 - n_present / n_evaluable, 6) AS missing_fraction, round(presence_gap, 6) AS presence_gap FROM profile"
)
def feature_profile(spark, sf_dir):
    return rounded(SC.feature_profile(counted_accounts(spark, sf_dir)), missing_fraction=6, presence_gap=6)


@query(
    LONG
    + """SELECT feature, round(greatest(raw, 1 - raw), 6) AS auc, CASE WHEN raw > 0.5 THEN 'higher_more_churn' WHEN raw < 0.5 THEN 'higher_less_churn' END AS direction FROM auc_n"""
)
def rank_auc(spark, sf_dir):
    return rounded(SC.rank_auc(counted_accounts(spark, sf_dir)), auc=6)


@query(
    LONG
    + """SELECT feature, n_levels, round(greatest(raw, 1 - raw), 6) AS auc, n_pure,
    CASE WHEN n_levels > 50 OR (n_pure > 0 AND n_levels > 1) THEN 'block' WHEN n_levels > 20 THEN 'warn' ELSE 'ok' END AS levels_verdict
    FROM lev2 JOIN auc_c USING (feature)"""
)
def category_screen(spark, sf_dir):
    return rounded(SC.category_screen(counted_accounts(spark, sf_dir)), auc=6)


@query(LONG + "SELECT feature, CASE WHEN NOT isnan(r) THEN round(r, 6) END AS tenure_correlation FROM tcorr")
def tenure_correlation(spark, sf_dir):
    return rounded(SC.tenure_correlation(counted_accounts(spark, sf_dir)), tenure_correlation=6)


@query(
    LONG
    + """, j AS (SELECT p.feature, p.kind, p.presence_gap, q.reason, l.n_levels, l.n_pure, t.r,
      CASE WHEN p.kind = 'number' THEN greatest(a.raw, 1 - a.raw) ELSE greatest(c.raw, 1 - c.raw) END AS auc
      FROM profile p JOIN promo2 q USING (feature) LEFT JOIN auc_n a USING (feature) LEFT JOIN auc_c c USING (feature)
      LEFT JOIN lev2 l USING (feature) LEFT JOIN tcorr t USING (feature)),
    k AS (SELECT feature, kind, concat_ws(',', CASE WHEN reason IN ('missingness', 'no variation') THEN 'promotion' END,
      CASE WHEN presence_gap >= 0.9 THEN 'presence' END, CASE WHEN kind = 'number' AND abs(r) >= 0.98 THEN 'tenure' END,
      CASE WHEN kind = 'category' AND n_levels > 50 THEN 'levels' END, CASE WHEN kind = 'category' AND n_pure > 0 AND n_levels > 1 THEN 'pure level' END,
      CASE WHEN auc >= 0.95 THEN 'auc' END) AS block,
      concat_ws(',', CASE WHEN reason = 'sparse events' THEN 'sparse events' END, CASE WHEN presence_gap >= 0.5 AND presence_gap < 0.9 THEN 'presence' END,
      CASE WHEN kind = 'category' AND n_levels BETWEEN 21 AND 50 THEN 'levels' END, CASE WHEN auc >= 0.85 AND auc < 0.95 THEN 'auc' END,
      CASE WHEN regexp_matches(lower(feature), 'churn|cancel|attrit|terminat|exit|closed|left|reason|outcome|label|target') THEN 'name' END) AS warn FROM j)
    SELECT feature, kind, CASE WHEN block <> '' THEN 'block' WHEN warn <> '' THEN 'warn' ELSE 'ok' END AS verdict, block, warn FROM k"""
)
def screening_verdict(spark, sf_dir):
    return SC.screen_features(long_accounts(spark, sf_dir))


# --- survival ----------------------------------------------------------------------------------------------

STATES = CANON + """, states AS (SELECT *, (plan_tier IS NOT NULL)::INT + (contract_length_months IS NOT NULL)::INT + (usage_frequency IS NOT NULL)::INT AS usable,
  CASE WHEN tenure <= 0 THEN 'NOT_ENOUGH_DATA' WHEN tenure <= 30 AND usable < 1 THEN 'NOT_ENOUGH_DATA' WHEN usable < 3 THEN 'EXCLUDED' ELSE 'SCORED' END AS state
  FROM accepted),
matrix AS (SELECT customer_id, CAST(tenure AS BIGINT) AS duration, event_observed AS event, plan_tier, contract_length_months, usage_frequency,
  (plan_tier = 'BUILDING')::DOUBLE AS b, (plan_tier = 'FURNITURE')::DOUBLE AS f, (plan_tier = 'HOUSEHOLD')::DOUBLE AS h, (plan_tier = 'MACHINERY')::DOUBLE AS m
  FROM states WHERE state = 'SCORED'),
strata AS (SELECT 'all' AS stratum, * FROM matrix UNION ALL SELECT plan_tier, * FROM matrix),
days AS (SELECT stratum, duration, count(*) AS n, sum(event) AS deaths, sum(1 - event) AS censored FROM strata GROUP BY 1, 2),
risk AS (SELECT *, sum(n) OVER (PARTITION BY stratum ORDER BY duration DESC) AS at_risk FROM days),
km AS (SELECT stratum, duration, at_risk, deaths, censored,
  CASE WHEN max((deaths >= at_risk)::INT) OVER w = 1 THEN 0.0 ELSE exp(sum(CASE WHEN deaths > 0 AND deaths < at_risk THEN ln(1 - deaths / at_risk) ELSE 0 END) OVER w) END AS survival,
  sum(CASE WHEN deaths > 0 AND deaths < at_risk THEN deaths / (at_risk * (at_risk - deaths)) ELSE 0.0 END) OVER w AS greenwood
  FROM risk WINDOW w AS (PARTITION BY stratum ORDER BY duration)),
hz AS (SELECT * FROM (VALUES (30), (90), (180)) v(horizon)),
kmh AS (SELECT s.stratum, horizon, coalesce((SELECT max_by(survival, duration) FROM km WHERE km.stratum = s.stratum AND duration <= horizon), 1.0) AS s,
  coalesce((SELECT max_by(greenwood, duration) FROM km WHERE km.stratum = s.stratum AND duration <= horizon), 0.0) AS g FROM (SELECT DISTINCT stratum FROM km) s, hz),
kmi AS (SELECT *, CASE WHEN s = 1 AND g = 0 THEN 1.0 WHEN s > 0 AND s < 1 AND g > 0 THEN pow(s, exp(1.959964 * sqrt(g) / abs(ln(s)))) END AS lo,
  CASE WHEN s = 1 AND g = 0 THEN 1.0 WHEN s > 0 AND s < 1 AND g > 0 THEN pow(s, exp(-1.959964 * sqrt(g) / abs(ln(s)))) END AS hi FROM kmh)
"""


def flat_accounts(spark, sf_dir):
    return accepted_accounts(spark, sf_dir).select(
        "customer_id", "tenure", "event_observed", *(F.col(f"core_features.{p}").alias(p) for p in PREDICTORS)
    )


def states(spark, sf_dir):
    return M.customer_states(flat_accounts(spark, sf_dir), PREDICTORS)


def matrix_of(spark, sf_dir):
    scored = states(spark, sf_dir).where("state = 'SCORED'")
    specs = M.feature_specs(scored, PREDICTORS)
    return M.design_matrix(scored, specs), specs


@query(
    STATES
    + """SELECT 'plan_tier' AS feature, 'categorical' AS kind, string_agg(DISTINCT plan_tier, ',' ORDER BY plan_tier) AS levels FROM matrix
    UNION ALL SELECT 'contract_length_months', 'numeric', '' UNION ALL SELECT 'usage_frequency', 'numeric', ''"""
)
def feature_specs(spark, sf_dir):
    specs = M.feature_specs(states(spark, sf_dir).where("state = 'SCORED'"), PREDICTORS)
    return spark.createDataFrame([(s.name, s.kind, ",".join(s.levels)) for s in specs], "feature string, kind string, levels string")


@query(STATES + "SELECT customer_id, state FROM states")
def customer_states(spark, sf_dir):
    return states(spark, sf_dir).select("customer_id", "state")


@query(
    STATES
    + """SELECT customer_id, duration, event, plan_tier AS plan_tier__raw, b AS "plan_tier_BUILDING", f AS "plan_tier_FURNITURE",
    h AS "plan_tier_HOUSEHOLD", m AS "plan_tier_MACHINERY", contract_length_months, usage_frequency FROM matrix"""
)
def design_matrix(spark, sf_dir):
    return matrix_of(spark, sf_dir)[0]


@query(
    STATES
    + """, a AS (SELECT count(*) AS n, sum(event) AS e, (SELECT count(*) FROM states) AS n0, max(greatest(b, f, h, m)) AS l FROM matrix),
    mc AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM matrix GROUP BY contract_length_months)), mu AS (SELECT max(c) AS top FROM (SELECT count(*) AS c FROM matrix GROUP BY usage_frequency)),
    g AS (SELECT 'customers' AS gate, n::DOUBLE AS value, n >= 200 AS ok FROM a UNION ALL SELECT 'events', e::DOUBLE, e >= 30 FROM a
    UNION ALL SELECT 'events_per_predictor', e / 6, e >= 60 FROM a UNION ALL SELECT 'excluded_share', 1 - n / n0, 1 - n / n0 <= 0.3 FROM a
    UNION ALL SELECT 'variation contract_length_months', 1 - top / n, 1 - top / n >= 0.05 FROM a, mc UNION ALL SELECT 'variation usage_frequency', 1 - top / n, 1 - top / n >= 0.05 FROM a, mu
    UNION ALL SELECT 'levels plan_tier', l, l >= 1 FROM a) SELECT gate, round(value, 6) AS value, ok FROM g"""
)
def eligibility(spark, sf_dir):
    m, specs = matrix_of(spark, sf_dir)
    return rounded(M.eligibility(m, specs, flat_accounts(spark, sf_dir).count()), value=6)


@query(
    STATES
    + """, a AS (SELECT count(*) AS n, sum(event) AS e, (SELECT count(*) FROM states) AS n0, median(duration) AS md,
      avg(CASE WHEN event = 1 THEN (duration < (SELECT max(duration) FROM matrix) / 2)::INT END) AS early FROM matrix),
    g AS (SELECT 'few_events' AS warning, e::DOUBLE AS value, e < 60 AS raised FROM a UNION ALL SELECT 'excluded', 1 - n / n0, 1 - n / n0 > 0.05 FROM a
    UNION ALL SELECT 'short_tenure', md, md < 90 FROM a UNION ALL SELECT 'early_events', early, coalesce(early > 0.6, false) FROM a)
    SELECT warning, round(value, 6) AS value, raised FROM g"""
)
def eligibility_warnings(spark, sf_dir):
    return rounded(M.eligibility_warnings(matrix_of(spark, sf_dir)[0], flat_accounts(spark, sf_dir).count()), value=6)


@query(
    STATES
    + """, c AS (SELECT 'plan_tier_BUILDING' AS a, 'plan_tier_FURNITURE' AS b, corr(b, f) AS r FROM matrix UNION ALL SELECT 'plan_tier_BUILDING', 'plan_tier_HOUSEHOLD', corr(b, h) FROM matrix
    UNION ALL SELECT 'plan_tier_BUILDING', 'plan_tier_MACHINERY', corr(b, m) FROM matrix UNION ALL SELECT 'plan_tier_FURNITURE', 'plan_tier_HOUSEHOLD', corr(f, h) FROM matrix
    UNION ALL SELECT 'plan_tier_FURNITURE', 'plan_tier_MACHINERY', corr(f, m) FROM matrix UNION ALL SELECT 'plan_tier_HOUSEHOLD', 'plan_tier_MACHINERY', corr(h, m) FROM matrix
    UNION ALL SELECT 'contract_length_months', 'usage_frequency', corr(contract_length_months, usage_frequency) FROM matrix)
    SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) > 0.2"""
)
def collinearity(spark, sf_dir):
    m, specs = matrix_of(spark, sf_dir)
    pairs = M.collinear_pairs(m, M.predictor_columns(specs), threshold=0.2)
    return rounded(pairs.where("(a like 'plan%') = (b like 'plan%')"), r=6)


@query(STATES + "SELECT stratum, duration, at_risk, deaths, censored, round(survival, 6) AS survival, round(greenwood, 8) AS greenwood FROM km WHERE stratum <> 'all'")
def km_table(spark, sf_dir):
    return rounded(M.km_table(matrix_of(spark, sf_dir)[0], "plan_tier__raw"), survival=6, greenwood=8)


@query(STATES + "SELECT stratum, horizon, round(s, 6) AS survival, round(lo, 6) AS lo, round(hi, 6) AS hi FROM kmi WHERE stratum <> 'all'")
def km_survival_at(spark, sf_dir):
    table = M.km_table(matrix_of(spark, sf_dir)[0], "plan_tier__raw")
    return rounded(M.km_survival_at(table), survival=6, lo=6, hi=6)


@query(
    STATES
    + """SELECT CASE WHEN min(n) >= 50 AND min(e) >= 10 THEN 'plan_tier' END AS segment FROM (SELECT count(*) AS n, sum(event) AS e FROM matrix GROUP BY plan_tier)"""
)
def km_segment(spark, sf_dir):
    m, specs = matrix_of(spark, sf_dir)
    return spark.createDataFrame([(M.km_segment(m, specs),)], "segment string")


@query(
    STATES
    + """, c AS (SELECT horizon, (SELECT count(*) FROM matrix WHERE duration >= horizon) AS n_observed, (SELECT count(*) FROM matrix WHERE duration >= horizon AND event = 1) AS n_events FROM hz)
    SELECT horizon, n_observed, n_events, round(hi - lo, 6) AS width, coalesce(n_observed >= 50 AND n_events >= 5 AND hi - lo <= 0.3, false) AS available
    FROM c JOIN (SELECT * FROM kmi WHERE stratum = 'all') k USING (horizon)"""
)
def horizon_status(spark, sf_dir):
    m, _ = matrix_of(spark, sf_dir)
    return rounded(M.horizon_status(m, M.km_table(m)), width=6)


#: DuckDB: forward survival over 90 days of active rows, by the global table.
FORWARD = STATES + """, g AS (SELECT duration, survival, greenwood FROM km WHERE stratum = 'all'), act AS (SELECT customer_id, duration AS s, event FROM matrix WHERE event = 0
  AND duration + 90 <= (SELECT max(duration) FROM matrix)),
f0 AS (SELECT act.customer_id, s, coalesce(g.survival, 1.0) AS s0, coalesce(g.greenwood, 0.0) AS g0 FROM act ASOF LEFT JOIN g ON act.s >= g.duration),
f1 AS (SELECT f0.*, f0.s + 90 AS s90 FROM f0),
f2 AS (SELECT f1.customer_id, s0, g0, coalesce(g.survival, 1.0) AS s1, coalesce(g.greenwood, 0.0) AS g1 FROM f1 ASOF LEFT JOIN g ON f1.s90 >= g.duration),
f3 AS (SELECT customer_id, CASE WHEN s0 > 0 THEN s1 / s0 END AS forward, CASE WHEN s1 > 0 THEN g1 - g0 END AS gr FROM f2),
fwd AS (SELECT customer_id, forward, CASE WHEN forward > 0 AND forward < 1 AND gr > 0 THEN pow(forward, exp(1.96 * sqrt(gr) / abs(ln(forward)))) END AS lo,
  CASE WHEN forward > 0 AND forward < 1 AND gr > 0 THEN pow(forward, exp(-1.96 * sqrt(gr) / abs(ln(forward)))) END AS hi FROM f3)
"""


def forward_90(spark, sf_dir):
    m, _ = matrix_of(spark, sf_dir)
    return M.km_forward(m.withColumn("stratum", F.lit("all")), M.km_table(m), 90)


@query(FORWARD + "SELECT customer_id, round(forward, 6) AS forward, round(lo, 6) AS lo, round(hi, 6) AS hi FROM fwd")
def km_forward(spark, sf_dir):
    return rounded(forward_90(spark, sf_dir), forward=6, lo=6, hi=6)


@query(
    STATES
    + """SELECT duration, round(CASE WHEN survival > 0 AND survival < 1 AND greenwood > 0 THEN pow(survival, exp(1.96 * sqrt(greenwood) / abs(ln(survival)))) END, 6) AS lo,
    round(CASE WHEN survival > 0 AND survival < 1 AND greenwood > 0 THEN pow(survival, exp(-1.96 * sqrt(greenwood) / abs(ln(survival)))) END, 6) AS hi FROM km WHERE stratum = 'all'"""
)
def loglog_interval(spark, sf_dir):
    table = M.km_table(matrix_of(spark, sf_dir)[0])
    lo, hi = M.loglog_interval(F.col("survival"), F.col("greenwood"))
    return rounded(table.select("duration", lo.alias("lo"), hi.alias("hi")), lo=6, hi=6)
