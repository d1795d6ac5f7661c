"""The Cox fit from daily sums against a fit on rows, and identities of what follows from it."""

import math

import numpy as np
import pytest
from stayline.operators import cox as C
from stayline.operators import survival as M
from stayline.plans.model import QUERIES


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(5)
    n = 300
    a, b = rng.normal(10, 3, n), rng.choice(["x", "y", "z"], n)
    time = np.ceil(rng.exponential(60 * np.exp(-0.1 * (a - 10) - 0.5 * (b == "y")))).astype(int) + 1
    event = (rng.random(n) < 0.6).astype(int)
    rows = [(f"c{i}", float(t), int(e), float(v), str(k)) for i, (t, e, v, k) in enumerate(zip(time, event, a, b))]
    df = spark.createDataFrame(rows, "customer_id string, tenure double, event_observed int, a double, b string")
    specs = M.feature_specs(df, ["a", "b"])
    return M.design_matrix(df, specs).cache(), specs, time, event, np.column_stack([a, b == "y", b == "z"]).astype(float)


def brute_fit(time, event, x, strata=None, ridge=0.1):
    """Newton on rows with Efron ties; coefficients on the original scale."""
    sd = x.std(0, ddof=1)
    z = (x - x.mean(0)) / sd
    n, p = z.shape
    strata = np.zeros(n, int) if strata is None else strata
    beta = np.zeros(p)
    for _ in range(60):
        g, h = np.zeros(p), np.zeros((p, p))
        w = np.exp(z @ beta)
        for s in np.unique(strata):
            for t in np.unique(time[(event == 1) & (strata == s)]):
                risk, dead = (time >= t) & (strata == s), (time == t) & (event == 1) & (strata == s)
                d = dead.sum()
                for k in range(d):
                    c = w * risk - (k / d) * w * dead
                    m1 = c @ z / c.sum()
                    m2 = (z * c[:, None]).T @ z / c.sum()
                    g -= m1
                    h -= m2 - np.outer(m1, m1)
                g += z[dead].sum(0)
        step = np.linalg.solve(-(h / n - ridge * np.eye(p)), g / n - ridge * beta)
        beta = beta + step
        if abs(step).max() < 1e-10:
            break
    return beta / sd


def test_fit_matches_rows(cohort):
    matrix, specs, time, event, x = cohort
    model = C.cox_fit(matrix, specs)
    assert model.columns == ["a", "b_y", "b_z"]
    assert np.allclose(model.beta, brute_fit(time, event, x), atol=1e-6)


def test_stratified_fit_matches_rows(cohort):
    matrix, specs, time, event, x = cohort
    model = C.cox_fit(matrix, specs, strata="b")
    strata = x[:, 1] + 2 * x[:, 2]
    assert model.columns == ["a"] and np.allclose(model.beta, brute_fit(time, event, x[:, :1], strata), atol=1e-6)


def test_fit_query_has_a_plain_and_a_stratified_fit(spark):
    rows = QUERIES["cox_fit"](spark, "/root/testdata/sf0.001").collect()
    plain = {r.column for r in rows if r.strata is None}
    stratified = {r.column for r in rows if r.strata == "plan_tier"}
    assert stratified and stratified < plain and not any(c.startswith("plan_tier") for c in stratified)
    assert all(r.sd > 0 and math.isfinite(r.coefficient) for r in rows)


def test_scores_contributions_and_forward_agree(spark, cohort, tmp_path):
    matrix, specs, *_ = cohort
    model = C.cox_fit(matrix, specs)
    scores = {r.customer_id: r for r in C.cox_scores(model, matrix, [30, 90], 45.0).collect()}
    shift = C.baseline_log_hazard(model, specs)
    for r in C.contributions(model, matrix, specs).collect():
        assert abs(sum(c.contribution for c in r.contributions) + shift - scores[r.customer_id].relative_log_hazard) < 1e-9
    base = [(d, h) for _, d, h, *_ in model.baseline]
    at = lambda day: max((h for d, h in base if d <= day), default=0.0)
    lp = {c: r.relative_log_hazard for c, r in scores.items()}
    rows = {r.customer_id: r.duration for r in matrix.collect()}
    got = C.cox_forward(model, matrix, M.km_table(matrix), 20).collect()
    assert got
    for r in got:
        s = rows[r.customer_id]
        assert abs(r.forward - math.exp(-(at(s + 20) - at(s)) * math.exp(lp[r.customer_id]))) < 1e-9
    digest = C.save_model(model, spark, str(tmp_path / "m"))
    assert digest and C.load_model(spark, str(tmp_path / "m")) == model
    spark.createDataFrame([("{}", digest)], "body string, digest string").write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        C.load_model(spark, str(tmp_path / "bad"))


def test_interval_holds_the_estimate(cohort):
    matrix, specs, *_ = cohort
    rows = C.cox_interval(C.cox_fit(matrix, specs), matrix, 40).collect()
    assert all(r.lo <= r.survival <= r.hi for r in rows if r.lo is not None)


def test_ph_test_is_calm_under_proportional_hazards(cohort):
    matrix, specs, *_ = cohort
    model = C.cox_fit(matrix, specs)
    p = C.ph_test(model, matrix)
    assert set(p) == set(model.columns) and all(0 <= v <= 1 for v in p.values()) and max(p.values()) > 0.01
    assert C.ph_decision(model, matrix, specs)[0] in ("keep", "stratify", "fallback")


@pytest.mark.parametrize("bucket_rows", [10, 40, 10_000])
def test_c_index_matches_all_pairs(spark, bucket_rows):
    rng = np.random.default_rng(1)
    rows = [(int(t), int(e), float(s)) for t, e, s in zip(rng.integers(1, 30, 200), rng.integers(0, 2, 200), rng.integers(0, 25, 200))]
    good = tied = pairs = 0
    for t, e, s in rows:
        if e:
            for u, f, v in rows:
                if u > t or (u == t and not f):
                    pairs, good, tied = pairs + 1, good + (s > v), tied + (s == v)
    got = C.c_index(spark.createDataFrame(rows, "duration long, event int, score double"), bucket_rows).first()
    assert (got.concordant, got.tied, got.pairs) == (good, tied, pairs)


def test_failures_are_named(spark, cohort):
    matrix, specs, *_ = cohort
    with pytest.raises(C.CoxFailure):
        C.cox_fit(matrix.where("event = 0"), specs)
    assert C.ph_preview(lambda f: (matrix.where("event = 0"), specs), ["a"]) == {"a": None}


def test_empty_cohort_has_no_model(spark):
    df = spark.createDataFrame([], "customer_id string, tenure double, event_observed int, a double")
    model = C.fit_survival(df, ["a"])
    assert model.status == "INSUFFICIENT_DATA" and C.score_survival(model, df, ["a"]).count() == 0


def test_dataset_version_ignores_order(spark, cohort):
    matrix = cohort[0]
    assert C.dataset_version(matrix) == C.dataset_version(matrix.repartition(7, "a"))
    assert C.dataset_version(matrix) != C.dataset_version(matrix.limit(10))


@pytest.mark.parametrize("bucket_rows", [20_000, 40])
def test_bootstrap_interval_matches_brute_force(spark, bucket_rows):
    rng = np.random.default_rng(8)
    n = 260
    time, event = rng.integers(1, 40, n), (rng.random(n) < 0.6).astype(int)
    score = np.round(rng.normal(0, 1, n) - 0.08 * time, 1)
    score[:60] = 0.25  # many ties
    df = spark.createDataFrame([(f"c{i}", float(t), int(e), float(s)) for i, (t, e, s) in enumerate(zip(time, event, score))], "customer_id string, duration double, event int, score double")
    u = df.selectExpr("customer_id", "transform(sequence(1, 200), r -> pmod(xxhash64(7, r, customer_id), 1073741824) / 1073741824D) as u").collect()
    u = {r.customer_id: r.u for r in u}
    u = np.array([u[f"c{i}"] for i in range(n)])
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    w = np.searchsorted(steps, u, side="right")
    lives = (event[:, None] == 1) & ((time > time[:, None]) | ((time == time[:, None]) & (event == 0)))
    value = 1.0 * (score[:, None] > score) + 0.5 * (score[:, None] == score)
    c = [(w[:, r] @ (lives * value) @ w[:, r]) / (w[:, r] @ lives @ w[:, r]) for r in range(200)]
    got = C.c_index_bootstrap(df, bucket_rows=bucket_rows).first()
    assert (got.lo, got.hi) == pytest.approx(np.percentile(c, [2.5, 97.5]), abs=1e-12)


def test_registered_bootstrap_has_all_rounds():
    from stayline.plans.model import CFG

    assert CFG.bootstrap == M.SurvivalConfig().bootstrap == 200


def published_cohort(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(400):
        tenure = max(1, int(rng.exponential(400.0)))
        event = int(rng.random() < 0.35)
        died = min(tenure, max(1, int(rng.exponential(400.0)))) if event else None
        rng.random()  # the draw for missing values, of which there are none
        plan = str(rng.choice(["basic", "pro", "enterprise"]))
        usage = float(rng.normal(25.0, 8.0))
        contract = float(rng.choice([6, 12, 24, 36]))
        rows.append((f"cus_{i:04d}", float(died or tenure), event, plan, contract, usage))
    return spark.createDataFrame(rows, "customer_id string, tenure double, event_observed int, plan_tier string, contract_length_months double, usage_frequency double")


def test_published_stratified_coefficients(spark):
    df = published_cohort(spark)
    specs = M.feature_specs(df, ["plan_tier", "contract_length_months", "usage_frequency"])
    model = C.cox_fit(M.design_matrix(df, specs), specs, strata="plan_tier")
    assert {c: round(b, 6) for c, b in zip(model.columns, model.beta)} == {"contract_length_months": -0.006998, "usage_frequency": -0.007479}


def test_the_whole_model_has_each_status(spark):
    df = published_cohort(spark).cache()
    predictors = ["plan_tier", "contract_length_months", "usage_frequency"]
    calm = M.SurvivalConfig(min_customers=50, min_events=10, ph_serious=0.0, bootstrap=20)
    model = C.fit_survival(df, predictors, calm)
    assert model.status in ("READY", "WARNING") and model.cox.strata is None and (model.status == "READY") == (not model.warnings)
    assert 0.5 < model.c_index < 1 and model.c_interval[0] <= model.c_interval[1]
    scored = C.score_survival(model, df, predictors, calm).collect()
    assert len(scored) == 400 and all(0 <= r.risk_score <= 1 for r in scored if r.state == "SCORED")
    strict = M.SurvivalConfig(min_customers=50, min_events=10, ph_serious=1.1, bootstrap=0)  # no p is as large
    fallback = C.fit_survival(df, predictors, strict)
    assert fallback.status == "FALLBACK" and fallback.cox is None and fallback.c_index is None
    tables = C.score_survival(fallback, df, predictors, strict).where("state = 'SCORED'").collect()
    assert all(r.risk_score == pytest.approx(1 - r.survival_90d) for r in tables)
    few = C.fit_survival(df.limit(20), predictors, calm)
    assert few.status == "FALLBACK" and few.warnings and few.cox is None and few.c_index is None
    scored = C.score_survival(few, df.limit(20), predictors, calm).where("state = 'SCORED'").collect()
    assert scored and all(r.risk_score == pytest.approx(1 - r.survival_90d) for r in scored)
    minor = M.SurvivalConfig(min_customers=50, min_events=10, ph_serious=0.0, ph_minor=1.1, bootstrap=0)  # any p is minor
    assert C.fit_survival(df, predictors, minor).status == "WARNING"


def test_the_five_statuses():
    assert C.model_status(True, "keep", "none", False, True) == "READY"
    for case in ((True, "keep", "none", True, True), (True, "keep", "minor", False, True), (True, "stratify", "serious", False, True)):
        assert C.model_status(*case) == "WARNING"
    for case in ((True, "fallback", "serious", False, True), (False, "fallback", "none", False, True)):
        assert C.model_status(*case) == "FALLBACK"
    assert C.model_status(True, "fallback", "none", False, False) == "FAILED"
    assert C.model_status(False, "fallback", "none", False, False) == "INSUFFICIENT_DATA"


def test_efron_sums_of_many_deaths_in_pieces():
    d, s0, d0 = 1000, 5000.0, 1200.0
    a = np.arange(d) / d
    phi = s0 - a * d0
    want = [np.log(phi).sum(), (1 / phi).sum(), (a / phi).sum(), (1 / phi**2).sum(), (a / phi**2).sum(), (a * a / phi**2).sum()]
    assert np.allclose(C._tie_sums(s0, d0, d, chunk=7), want, rtol=1e-12)


def test_hazard_ratios_by_hand(spark):
    model = C.CoxModel(["a", "b"], [0.2, -0.5], [0.0, 0.0], [1.0, 1.0], [[0.01, 0.0], [0.0, 0.04]], 10, 5)
    a, b = sorted(C.hazard_ratios(spark, model).collect(), key=lambda r: r.column)
    assert (a.hazard_ratio, a.lo, a.hi) == pytest.approx((math.exp(0.2), math.exp(0.2 - 0.196), math.exp(0.2 + 0.196)))
    assert a.p == pytest.approx(math.erfc(2 / math.sqrt(2))) and b.p == pytest.approx(math.erfc(2.5 / math.sqrt(2)))
    assert "raises" in a.sentence and "1.221" in a.sentence and "lowers" in b.sentence


def test_inflation_is_that_of_regressions(cohort):
    matrix, _, _, _, x = cohort
    got = M.variance_inflation(matrix, ["a", "b_y", "b_z"])
    for k, name in enumerate(("a", "b_y", "b_z")):
        rest = np.column_stack([np.ones(len(x)), np.delete(x, k, 1)])
        fit = rest @ np.linalg.lstsq(rest, x[:, k], rcond=None)[0]
        assert got[name] == pytest.approx(((x[:, k] - x[:, k].mean()) ** 2).sum() / ((x[:, k] - fit) ** 2).sum())


def test_ph_test_sees_a_hazard_that_turns(spark):
    """A covariate that harms early and helps late is found; on the rows, the residuals give the same p."""
    rng = np.random.default_rng(3)
    n = 400
    x = rng.normal(0, 1, n)
    time = np.where(rng.random(n) < 1 / (1 + np.exp(-2 * x)), rng.integers(1, 20, n), rng.integers(20, 60, n))
    df = spark.createDataFrame([(f"c{i}", float(t), 1, float(v)) for i, (t, v) in enumerate(zip(time, x))], "customer_id string, tenure double, event_observed int, x double")
    specs = M.feature_specs(df, ["x"])
    matrix = M.design_matrix(df, specs)
    model = C.cox_fit(matrix, specs)
    p = C.ph_test(model, matrix)["x"]
    beta, residuals = model.beta[0], []
    for t, v in zip(time, x):
        risk = time >= t
        w = np.exp(beta * x[risk])
        residuals.append(v - (w @ x[risk]) / w.sum())
    rank = np.array([(time < t).sum() + ((time == t).sum() + 1) / 2 for t in time])
    r = np.corrcoef(residuals, rank)[0, 1]
    t = r * math.sqrt((n - 2) / (1 - r * r))
    from stayline.functions.stats import t_p

    assert p == pytest.approx(t_p(t, n - 2), rel=1e-6) and p < 0.001
    assert C.ph_decision(model, matrix, specs)[0] == "fallback"  # there is no category to stratify by


def test_versions_are_the_same_for_any_engine(spark):
    """Two sessions' worth of dealing, and each change of a value, a row or the settings."""
    df = spark.range(100).selectExpr("id", "id * 2 as v", "concat('k', id) as k")
    version = C.dataset_version(df, "cfg")
    assert version == C.dataset_version(df.select("k", "v", "id").repartition(9, "v").orderBy("k"), "cfg")
    assert len({version, C.dataset_version(df, "other"), C.dataset_version(df.limit(99), "cfg"), C.dataset_version(df.replace(4, 5, ["v"]), "cfg"), C.dataset_version(df.union(df.limit(1)), "cfg")}) == 5
