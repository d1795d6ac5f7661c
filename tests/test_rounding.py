"""Rounded and ranked scores are SQL's to the last bit, so that ties are the same ties."""

import duckdb
from pyspark.sql import functions as F
from stayline.functions.scalars import half_even
from stayline.operators import ranking as R


def test_half_even_takes_the_ties_of_sql(spark):
    con = duckdb.connect()
    products = "SELECT p / 20::double AS p, h / 1000::double AS h FROM range(0, 21) a(p), range(500, 1001) b(h)"
    sums = "SELECT a / 1000::double AS p, n / 40::double AS h FROM range(0, 1001) a(a), range(0, 41) n(n)"
    for rows, sql, ours in (
        (products, "p * h", lambda: F.col("p") * F.col("h")),
        (sums, "0.55 * p + 0.45 * h", lambda: 0.55 * F.col("p") + 0.45 * F.col("h")),
        (products, "p - 10 * h", lambda: F.col("p") - 10 * F.col("h")),
    ):
        want = con.execute(f"SELECT p, h, round_even({sql}, 3) AS want FROM ({rows})").df()
        assert spark.createDataFrame(want).where(half_even(ours()) != F.col("want")).count() == 0
    assert spark.range(1).select(half_even(F.lit(None).cast("double"))).first()[0] is None


def test_equal_scores_stay_equal(spark):
    """0.85 * 0.33 and 0.4 of it are decimals in SQL; noise of doubles would order accounts that tie."""
    weights = ("cancellation_intent 1.0", "renewal_or_contract_concern 0.85", "billing_complaint 0.55", "competitor_mention 0.45")
    rows = [(f.split()[0], float(f.split()[1]), s, w, n) for f in weights for s, w in (("weak", 0.33), ("moderate", 0.66), ("strong", 1.0)) for n in range(1, 7)]
    con = duckdb.connect()
    one = lambda w, s, n: f"least(1, {w} * {s} + least(0.2, 0.05 * greatest(0, {n} - 1)))"
    df = spark.createDataFrame(rows, "flag_type string, w double, signal_strength string, s double, recurrence long")
    flag = F.struct("flag_type", F.lit("low").alias("severity"), "signal_strength", "recurrence")
    df = df.crossJoin(spark.range(0, 1001, 50).select((F.col("id") / 1000).alias("quant"))).withColumn("flags", F.array(flag))
    df = df.withColumn("qual", R.qualitative_score(F.lit("sufficient_data")))
    for r in df.withColumn("score", R.combined_score(F.col("quant"), F.col("qual"), F.lit("weak"))).collect():
        want = con.execute(f"SELECT least(1, greatest(0, 0.6 * {r.quant}::double + 0.4 * {one(r.w, r.s, r.recurrence)}))").fetchone()[0]
        assert r.score == float(want), r
