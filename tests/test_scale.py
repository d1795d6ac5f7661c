"""Joins and counts that must not gather a busy customer, a frequent id or a frequent score in one place."""

import datetime as dt
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stayline.functions.claims import with_first
from stayline.operators import cox as C
from stayline.operators import ranking as R
from stayline.operators import support as T

START = dt.datetime(2024, 1, 1)
DOCS = "thread_id string, customer_id string, created_at timestamp, subject string, doc string"


def brute_similar(rows, least, hours=48):
    found = {}
    for customer in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == customer]
        tf = {r[0]: Counter(re.findall(r"\w{2,}", r[4].lower())) for r in mine}
        df = Counter(t for c in tf.values() for t in c)
        vec = {}
        for i, c in tf.items():
            v = {t: k * (math.log((1 + len(mine)) / (1 + df[t])) + 1) for t, k in c.items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            vec[i] = {t: x / size for t, x in v.items()}
        for x in mine:
            for y in mine:
                if (x[2], x[0]) < (y[2], y[0]) and (y[2] - x[2]).total_seconds() <= hours * 3600:
                    cosine = sum(w * vec[y[0]].get(t, 0) for t, w in vec[x[0]].items())
                    if cosine >= least:
                        found[x[0], y[0]] = round(cosine, 9)
    return found


def test_similar_threads_equal_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for k in range(240):
        text = rng.choices(words, weights=[1 / (1 + j) for j in range(40)], k=rng.choice([0, 1, 3, 8, 12]))
        if k % 3 == 1 and rows:  # a near copy of an earlier thread
            text = rows[-1][4].split() + rng.choices(words, k=rng.randint(0, 2))
        rows.append((f"t{k}", f"c{k % 2}" if k % 3 != 1 else rows[-1][1] if rows else "c0", START + dt.timedelta(hours=rng.randint(0, 150)), "s", " ".join(text)))
    df = spark.createDataFrame(rows, DOCS)
    for least in (0.82, 0.5, 0.2):
        got = {(r.a, r.b): round(r.cosine, 9) for r in T.similar_threads(df, least).collect()}
        want = brute_similar(rows, least)
        assert got.keys() == want.keys() and want
        assert all(abs(got[k] - want[k]) < 1e-7 for k in want)


def test_busy_customer(spark):
    """20,000 threads of one customer in two days, in common words with one or two of their own."""
    rng = random.Random(4)
    common = [f"common{k}" for k in range(8)]
    rows = [(f"t{k:05d}", "busy", START + dt.timedelta(seconds=rng.randint(0, 172_800)), "s", " ".join([*rng.sample(common, 4), f"own{k // 2}", f"also{k // 2}"])) for k in range(20_000)]
    got = {(min(r.a, r.b), max(r.a, r.b)) for r in T.similar_threads(spark.createDataFrame(rows, DOCS), 0.82).collect()}
    assert got == {(f"t{k:05d}", f"t{k + 1:05d}") for k in range(0, 20_000, 2)}


def test_first_claims_with_frequent_null_and_blank_ids(spark):
    rng = random.Random(5)
    ids = [rng.choice(["unknown", "", None, f"c{rng.randint(0, 2000)}"]) for _ in range(6000)]
    df = spark.createDataFrame([(k, i) for k, i in enumerate(ids)], "row_id long, customer_id string").repartition(7)
    first, n = {}, Counter(ids)
    for k, i in enumerate(ids):
        first.setdefault(i, k)
    got = {r.row_id: r.f for r in with_first(df, "customer_id", "row_id", "f").collect()}
    assert got == {k: first[i] if i is not None and n[i] > 1 else None for k, i in enumerate(ids)}


def test_rows_of_a_frequent_id_are_dealt_evenly(spark):
    """Half of all rows have one id; after the join that finds its first row they lie in all partitions."""
    old = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = spark.range(100_000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 2 == 0, "unknown").otherwise(F.concat(F.lit("c"), F.floor(F.col("id") / 4))).alias("customer_id"))
        sizes = [r["count"] for r in with_first(df, "customer_id", "row_id", "f").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 100_000 and max(sizes) < 1.1 * 100_000 / len(sizes) and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])


def test_first_of_each(spark):
    df = spark.createDataFrame([("a", 2, "x", None), ("a", 1, None, {"k": 1}), (None, 5, "n", None), ("b", 1, "y", None)], "customer_id string, pos int, v string, m map<string,int>")
    got = {r.customer_id: (r.v, r.m) for r in R.first_of_each(df).collect()}
    assert got == {"a": (None, {"k": 1}), None: ("n", None), "b": ("y", None)}


def survivors(n, seed, frequent=0.0):
    rng = random.Random(seed)
    return [(f"c{k}", rng.randint(1, 30), int(rng.random() < 0.4), 0.5 if rng.random() < frequent else round(rng.random(), 2)) for k in range(n)]


def all_pairs(rows, w=None):
    t, e, s = (np.array([r[k] for r in rows]) for k in (1, 2, 3))
    w = np.ones(len(rows)) if w is None else w
    usable = (e[:, None] == 1) & ((t[None] > t[:, None]) | ((t[None] == t[:, None]) & (e[None] == 0)))
    weight = np.outer(w, w) * usable
    return weight[s[None] < s[:, None]].sum(), weight[s[None] == s[:, None]].sum(), weight.sum()


def test_concordance_with_a_frequent_score(spark):
    rows = survivors(900, 6, frequent=0.4)
    df = spark.createDataFrame([*rows, ("x", 3, 1, None), ("y", None, 0, 0.5)], "customer_id string, duration int, event int, score double")
    got = C.c_index(df.drop("customer_id"), bucket_rows=40).first()
    assert (got.concordant, got.tied, got.pairs) == all_pairs(rows)


def test_bootstrap_equals_all_pairs_in_every_round(spark):
    rows, rounds = survivors(400, 7, frequent=0.4), 20
    df = spark.createDataFrame(rows, "customer_id string, duration int, event int, score double")
    draw = df.select("customer_id", *(F.pmod(F.xxhash64(F.lit(7), F.lit(r), "customer_id"), F.lit(1 << 30)).alias(f"r{r}") for r in range(1, rounds + 1))).collect()
    limits = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(8)])
    drawn = {d.customer_id: np.searchsorted(limits, np.array(d[1:]) / (1 << 30), side="right") for d in draw}
    values = []
    for r in range(rounds):
        good, tied, pairs = all_pairs(rows, np.array([drawn[x[0]][r] for x in rows]))
        values.append((good + tied / 2) / pairs)
    for bucket_rows in (20, 100_000):
        lo, hi = C.c_index_bootstrap(df, rounds, bucket_rows=bucket_rows).first()
        assert abs(lo - np.percentile(values, 2.5)) < 1e-12 and abs(hi - np.percentile(values, 97.5)) < 1e-12


def test_threads_are_read_from_one_written_table(spark):
    """Texts were put together anew by each reader, and terms shuffled for every count, norm and prefix."""
    rows = [("c", "t1", dt.datetime(2024, 1, 1), "b a b"), ("c", "t2", dt.datetime(2024, 1, 2), "aa bb aa cc"), ("c", "t3", dt.datetime(2024, 1, 2), "aa")]
    threads = spark.createDataFrame([(t, c, at, text, None) for c, t, at, text in rows], "thread_id string, customer_id string, created_at timestamp, subject string, duplicate_of string")
    messages = spark.createDataFrame([], "thread_id string, message_id string, ts timestamp, role string, text string")
    docs = T.candidate_text(threads, messages)
    assert "Exchange" not in docs._jdf.queryExecution().executedPlan().toString()
    weights = T.weighted_threads(docs)
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()
    got = {r.thread_id: [(t.df, t.term, round(t.w, 9)) for t in r.terms] for r in weights.collect()}
    one, two = math.log(4 / 2) + 1, 2 * (math.log(4 / 3) + 1)
    norm = math.sqrt(2 * one * one + two * two)
    assert got == {"t2": [(1, "bb", round(one / norm, 9)), (1, "cc", round(one / norm, 9)), (2, "aa", round(two / norm, 9))], "t3": [(2, "aa", 1.0)]}


def test_correlations_aggregate_plain_columns(spark):
    """Cells were parsed inside the aggregate: its code didn't compile, and every row was interpreted."""
    from stayline.operators import validate as V

    rows = [(k, "x" if k == 3 else str(k * k % 7), str(k % 5) + ".50", float(k)) for k in range(40)]
    df = spark.createDataFrame(rows, "k long, odd string, fine string, used double").select(
        F.create_map(F.lit("odd"), F.col("odd"), F.lit("fine"), F.col("fine")).alias("extra_features"),
        F.struct(F.lit("gold").alias("plan_tier"), F.col("used").alias("usage_frequency")).alias("core_features"),
    )
    found = V.correlation_warnings(df, ["odd", "fine"], V.ValidationConfig(correlation_threshold=0.0001))
    want = np.corrcoef([r[3] for r in rows], [float(r[2]) for r in rows])[0, 1]
    assert [(r.extra, r.core, round(r.r, 9)) for r in found.collect()] == [("fine", "usage_frequency", round(want, 9))]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Aggregate(" in line and "RLIKE" in line]
