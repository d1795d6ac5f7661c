"""Small cases of the operators: edges that the tables of the data folder don't hold."""

import pytest
from pyspark.sql import functions as F
from stayline.functions import scalars as S
from stayline.operators import adapters as A
from stayline.operators import external as X
from stayline.operators import ranking as R
from stayline.operators import routing
from stayline.operators import support as T
from stayline.operators import validate as V
from stayline.sources import tables
from stayline.streaming.canonical import canonical_stream, write_stream

REF = "2025-06-30"


def values(spark, function, cells, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
    return [r[1] for r in rows.select("i", function(F.col("c"))).orderBy("i").collect()]


def test_dates(spark):
    cells = ["2025-03-12", "20250312", "2025-03-12T10:00:00Z", "2025/3/12", "2025.03.12", "03/12/2025", "12-03-2025", "Mar 12, 2025", "12 Mar 2025", " ", None, "2025-W11-3", "31/31/2025", "2025-02-30"]
    got = values(spark, lambda c: S.parse_date(c).cast("string"), cells)
    assert got == ["2025-03-12"] * 9 + [None] * 5


def test_numbers(spark):
    cells = ["1,234.5", "12,34", "1e3", ".5", "nan", "inf", "", "True", " 7 ", "1e999", "-2"]
    assert values(spark, S.to_float, cells) == [1234.5, None, 1000.0, 0.5, None, None, None, None, 7.0, None, -2.0]
    assert values(spark, S.to_int, ["3.0", "3.5", "1,000"]) == [3, None, 1000]


def test_status_words_and_maps(spark):
    assert values(spark, S.status_to_event, [" Churned ", "LEAD", "1", "mystery", None]) == [1, 0, None, None, None]
    assert values(spark, lambda c: S.map_values(c, {"Gold": "g", "gold ": "h"}), ["gold ", "GOLD", "x"]) == ["h", "g", None]


def test_unknown_transform_is_refused(spark):
    df = spark.createDataFrame([(1, "x")], "_row_id long, a string")
    with pytest.raises(ValueError):
        A.apply_mapping(df, [A.ColumnMapping("a", "customer_id", "eval")], REF)


def canonical(spark, rows):
    cols = "_row_id long, customer_id string, observation_start string, observation_end string, event_observed string, plan_tier string, contract_length_months string, usage_frequency string"
    return A.adapt_canonical(spark.createDataFrame(rows, cols), REF)


def test_validation_splits_and_reports(spark):
    rows = [(i, f"c{i}", "2025-01-01", None, "active", "pro", "12", "3") for i in range(10)]
    rows += [(20, "c1", "2025-01-01", None, "active", "pro", "12", "3"), (21, None, "2026-01-01", None, "what", None, "12", "3"), (22, "c22", "2025-01-01", None, "no", "", "12", "3")]
    v = V.validate(canonical(spark, rows), V.ValidationConfig(), REF)
    assert v.report.first() == (13, 11, 2, "PARTIAL")
    codes = {(r.row_id, r.code) for r in v.errors.collect()}
    assert codes == {(20, "UNIQUE_ID"), (21, "CUSTOMER_ID"), (21, "WINDOW_ORDER"), (21, "EVENT_OBSERVED"), (21, "TENURE_INVALID")}  # plan_tier passes
    assert v.accepted.count() + v.rejected.count() == 13


def test_batch_gates_reject_everything(spark):
    rows = [(i, f"c{i}", "2025-01-01", None, "active", None if i < 5 else "pro", "12", "3") for i in range(10)]
    v = V.validate(canonical(spark, rows), V.ValidationConfig(), REF)
    assert v.accepted.count() == 0 and v.report.first().status == "FAILED"
    assert "COLUMN_MISSINGNESS" in {r.code for r in v.errors.collect()}
    same_day = [(i, f"c{i}", REF, None, "active", "pro", "12", "3") for i in range(10)]
    assert V.validate(canonical(spark, same_day), V.ValidationConfig(), REF).report.first().status == "FAILED"
    assert V.validate(canonical(spark, rows[:0]), V.ValidationConfig(), REF).report.first().n_input == 0


def test_tables_are_picked_by_name_or_size(spark):
    frames = {"small": spark.range(2), "Customers": spark.range(1), "big": spark.range(5)}
    assert routing.pick_table(frames) == "big" and routing.pick_table(frames, ("customers",)) == "Customers"


def messages(spark, *texts):
    rows = [("t", f"m{i}", f"2024-01-0{i + 1} 00:00:00", "customer", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "thread_id string, message_id string, ts string, role string, text string")
    return df.withColumn("ts", F.to_timestamp("ts"))


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (("please cancel my plan",), {"cancellation_intent"}),
        (("do not please cancel",), set()),
        (("never an outage",), set()),
        (("it is not one of many, this is a crash",), {"product_bug_or_outage"}),
        (("not renewing",), {"cancellation_intent"}),
        (("the debugger",), set()),
        (("nothing", "refund"), {"billing_complaint"}),
    ],
)
def test_keyword_flags(spark, texts, want):
    assert {r.flag_type for r in T.extract_flags(messages(spark, *texts)).collect()} == want


def test_negation_reaches_across_messages(spark):
    assert T.thread_mentions(messages(spark, "it is not", "cancel")).first().churn_language is False


def test_duplicates_follow_hints_and_survivors(spark):
    rows = [
        ("a", "c", "2024-01-01 00:00:00", "login broken", None, "login broken today again", 9),
        ("b", "c", "2024-01-01 10:00:00", "login broken", "a", "login broken today again", 9),
        ("d", "c", "2024-01-09 10:00:00", "login broken", "a", "login broken today again", 3),
        ("e", "c", "2024-01-09 11:00:00", "login broken!", None, "login broken today again", 5),
        ("f", "k", "2024-01-09 11:00:00", "login broken!", None, "login broken today again", 5),
    ]
    df = spark.createDataFrame(rows, "thread_id string, customer_id string, created_at string, subject string, duplicate_of string, doc string, tokens int")
    df = df.withColumn("created_at", F.to_timestamp("created_at"))
    cfg = T.SupportConfig()
    got = {r.thread_id: r.duplicate_of for r in T.collapse_duplicates(df, T.duplicate_pairs(df, cfg), cfg).collect()}
    assert got == {"b": "a", "d": "e"}


def test_cap_stops_at_the_first_overflow(spark):
    rows = [(f"t{i}", "c", f"2024-01-{10 - i:02d} 00:00:00", "supported", n) for i, n in enumerate((10, 100, 5))]
    df = spark.createDataFrame(rows, "thread_id string, customer_id string, created_at string, language_status string, tokens int")
    got = {r.thread_id: r.kept for r in T.cap_threads(df, T.SupportConfig(max_tokens=50)).collect()}
    assert got == {"t0": True, "t1": False, "t2": False}


def test_lift_points(spark):
    cells = [0.0, 0.1, 0.15, 0.3, 0.6, 0.9, None]
    got = values(spark, lambda c: R.lift_risk(c, F.lit(0.1))[0], cells, "double")
    assert got == [0.0, 0.2, 0.4, 0.7, 1.0, 1.0, None]


def test_dms_and_collisions(spark):
    dms = spark.createDataFrame([("d1", [("m1", "u", "hi", "2024-01-01"), ("m2", " ", "x", "2024-01-01")])], "conversation_id string, messages array<struct<id:string,sender_id:string,text:string,created_at:string>>")
    assert [r.message_id for r in X.parse_dms(dms).collect()] == ["m1"]


def test_csv_keeps_ids_and_order(spark, tmp_path):
    (tmp_path / "t.csv").write_text("id,name\n" + "".join(f"00{i},n{i}\n" for i in range(50)))
    rows = tables.read_table(spark, str(tmp_path / "t.csv")).orderBy("_row_id").collect()
    assert [r.id for r in rows] == [f"00{i}" for i in range(50)] and [r._row_id for r in rows] == list(range(50))
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.docx")


def brute_collapse(threads, links):
    """The rule read off literally: list every merge that could be, in order, and carry them out one after another.

    Rows are (thread, customer, created, hint, tokens).
    """
    by_time = sorted(threads, key=lambda r: (r[2], r[0]))
    merges = [("hint", t, hint) for t, _, _, hint, _ in by_time if hint]
    merges += [("pair", a[0], b[0]) for n, a in enumerate(by_time) for b in by_time[n + 1 :] if (a[0], b[0]) in links]
    strength = {t: (n, [-ord(c) for c in at], [-ord(c) for c in t]) for t, _, at, _, n in threads}
    into = {}
    for kind, a, b in merges:
        if kind == "hint":
            while b in into:
                b = into[b]
            if (a, b) not in links and (b, a) not in links:
                continue
        if a == b or a in into or b in into:
            continue
        stays = max(a, b, key=strength.get)
        into[a if stays == b else b] = stays
    return into


def test_duplicates_settle_by_links(spark):
    import random

    rng = random.Random(4)
    n = 240
    at = lambda k: f"2024-01-{1 + k // 24:02d} {k % 24:02d}:00:00"
    threads = [(f"t{rng.random()}", "c", at(k), None, rng.randint(1, 4)) for k in range(n)]
    links = {(threads[i][0], threads[j][0]) for i, j in (sorted(rng.sample(range(g, min(n, g + 8)), 2)) for g in rng.choices(range(0, n - 8, 4), k=250))}
    hints = {**{rng.choice(p): q for p in links for q in p if rng.random() < 0.2}, **{rng.choice(threads)[0]: rng.choice(threads)[0] for _ in range(20)}}
    threads = [(t, c, a, hints.get(t), k) for t, c, a, _, k in threads]
    df = spark.createDataFrame(threads, "thread_id string, customer_id string, created_at string, duplicate_of string, tokens int").withColumn("created_at", F.to_timestamp("created_at"))
    pairs = spark.createDataFrame([("c", *p) for p in links], "customer_id string, a string, b string")
    want = brute_collapse(threads, links)
    assert len(want) > 50
    assert {r.thread_id: r.duplicate_of for r in T.collapse_duplicates(df, pairs, T.SupportConfig()).collect()} == want


def test_threads_without_links_stay_out(spark):
    """A busy customer: one chain of 20,000 threads with two links."""
    hours = spark.range(20_000).selectExpr("concat('t', id) as thread_id", "'c' as customer_id", "timestamp_seconds(1600000000 + id * 3600) as created_at", "cast(null as string) as duplicate_of", "1 as tokens")
    pairs = spark.createDataFrame([("c", "t5", "t9"), ("c", "t19000", "t19001")], "customer_id string, a string, b string")
    got = {r.thread_id: r.duplicate_of for r in T.collapse_duplicates(hours, pairs, T.SupportConfig()).collect()}
    assert got == {"t9": "t5", "t19001": "t19000"}


def test_hints_run_in_circles_backwards_and_to_nowhere(spark):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    threads = [
        ("a", "c", at(0), "b", 1), ("b", "c", at(1), "c", 1), ("c", "c", at(2), "a", 1),  # a circle
        ("p", "c", at(3), "q", 5), ("q", "c", at(4), None, 9),  # to a later thread, which stays
        ("x", "c", at(5), "x", 1), ("y", "c", at(6), "nobody", 1),  # to itself, to none
        ("m", "c", at(7), None, 2), ("n", "c", at(7), None, 2),  # equal in all but the id
    ]
    links = {("a", "b"), ("b", "c"), ("a", "c"), ("p", "q"), ("m", "n"), ("x", "y")}
    df = spark.createDataFrame(threads, "thread_id string, customer_id string, created_at string, duplicate_of string, tokens int").withColumn("created_at", F.to_timestamp("created_at"))
    pairs = spark.createDataFrame([("c", *p) for p in links], "customer_id string, a string, b string")
    got = {r.thread_id: r.duplicate_of for r in T.collapse_duplicates(df, pairs, T.SupportConfig()).collect()}
    assert got == brute_collapse(threads, links) == {"b": "a", "c": "a", "p": "q", "n": "m", "y": "x"}


def test_negations_reach_three_tokens(spark):
    texts = ["not a b cancel", "not a b c cancel", "cancel not cancel", "don't'cancel", "xcancel", "é cancel", "no-cancel", "not\n\ta, outage; bug", "", None, "cancel " * 3000]
    want = [False, True, True, True, False, True, False, None, False, False, True]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", T.mentioned(F.lower(F.coalesce("text", F.lit(""))), ["cancel"]).alias("hit"))
    got = [r.hit for r in df.orderBy("id").collect()]
    assert [g for g, w in zip(got, want) if w is not None] == [w for w in want if w is not None]


def test_threads_from_json(spark, tmp_path):
    (tmp_path / "t.json").write_text('[{"thread_id": "t1", "customer_id": "c", "messages": [{"message_id": "m", "timestamp": "2024-01-01T00:00:00Z", "role": "customer", "text": "x"}]}]')
    threads, msgs = tables.flatten_threads(tables.read_threads(spark, str(tmp_path / "t.json")))
    assert threads.count() == 1 and msgs.first().message_id == "m"


def test_streams_give_the_same_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("customer_id,observation_start,observation_end,event_observed\nc1,2025-01-01,,active\nc2,2025-01-01,2025-02-01,churned\n")
    schema = "customer_id string, observation_start string, observation_end string, event_observed string"
    stream = canonical_stream(spark, str(tmp_path / "in"), schema, A.adapt_canonical, REF)
    write_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = {r.customer_id: (r.event_observed, r.tenure) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"c1": (0, 180.0), "c2": (1, 31.0)}


def test_ranks_split_ties_over_ranges(spark, request):
    """Half of the rows share the first value; a null sorts first; peers share their running sum."""
    from pyspark.sql import functions as F
    from stayline.functions.ranks import global_rank, in_ranges, running_sum

    df = spark.range(4000).selectExpr("if(id % 2 = 0, 7, if(id % 11 = 0, null, id)) as x", "id", "id % 3 as g", "1 as n")
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"  # which makes one range of a table as small as this
    spark.conf.set(coalesce, "false")
    request.addfinalizer(lambda: spark.conf.unset(coalesce))
    ranged = in_ranges(df, ["x", "id"])
    assert ranged.where("x = 7").select("_range").distinct().count() > 1
    ranks = {r.id: r["rank"] for r in global_rank(df, [F.asc("x"), F.desc("id")]).collect()}
    rows = df.collect()
    order = sorted(rows, key=lambda r: (r.x is not None, r.x or 0, -r.id))
    assert [ranks[r.id] for r in order] == list(range(1, 4001))
    got = {(r.g, r.x): r.cum for r in running_sum(df.where("x is not null"), ["g"], "x", "n", "cum").collect()}
    for g in range(3):
        xs = sorted(r.x for r in rows if r.g == g and r.x is not None)
        assert all(got[g, x] == sum(y <= x for y in xs) for x in set(xs[:: len(xs) // 50]))


# --- explanations ------------------------------------------------------------------------------------------

FACTS = {"display_name": "Acme 3000", "level": "high", "numbers": [0.62, 2.5, 1234.5], "integers": [90, 2], "flag_types": ["billing_complaint"], "evidence_ids": ["msg_1"], "recommendation": None}


def violations(spark, text, **changes):
    from stayline.operators import report as P

    f = FACTS | changes
    schema = "customer_id string, display_name string, level string, numbers array<double>, integers array<bigint>, flag_types array<string>, evidence_ids array<string>, recommendation string, reference_date date"
    day = __import__("datetime").date(2026, 8, 15)
    facts = spark.createDataFrame([("cus_7", f["display_name"], f["level"], f["numbers"], f["integers"], f["flag_types"], f["evidence_ids"], f["recommendation"], day)], schema)
    found = P.check_explanations(spark.createDataFrame([("cus_7", text)], "customer_id string, text string"), facts)
    return {(r.code.replace("UNSUPPORTED_", ""), r.found) for r in found.collect()}


@pytest.mark.parametrize(
    "text, want",
    [
        ("CUS_7, or acme 3000, is at high risk with a score of 0.62 and 2.5 times the average over 90 days.", set()),
        ("A score of 0.620, 0.6 or 1234.50.", set()),
        ("A score of 0.61 and 3.", {("NUMBER", "0.61"), ("NUMBER", "3")}),
        ("About 62% and 90%.", {("NUMBER", "62%"), ("NUMBER", "90%")}),
        ("Two seats of seven, ninety days.", {("NUMBER", "seven")}),
        ("On 2026-08-15 at 09:30, not 2026-08-16.", {("DATE", "2026-08-16"), ("TIMESTAMP", "09:30")}),
        ("In August 2026, on 3 August and March 3, 2026; August 2025. They may leave; 5.", {("DATE", "March 3, 2026"), ("DATE", "August 2025"), ("NUMBER", "5")}),
        ("See msg_1 and thr_22.", {("EVIDENCE", "thr_22")}),
        ("A medium or LOW risk, highly lowered.", {("RISK_LEVEL_MISMATCH", "medium"), ("RISK_LEVEL_MISMATCH", "low")}),
        ("They will terminate the plan.", {("CANCELLATION_CLAIM", "terminat")}),
        ("There is a chance of churn.", {("CONFIDENCE_AS_PROBABILITY", "chance of")}),
        ("An outage upset them over the price.", {("RISK_FACTOR", "outage")}),
        ("A merger made them sign.", {("CUSTOMER_FACT", "merger")}),
        ("Offer a refund.", {("RECOMMENDATION", "offer"), ("RECOMMENDATION", "refund")}),
        ("We recommend patience; no risk, they stay active.", {("CONTRADICTS_NODE4", "no risk"), ("CONTRADICTS_NODE4", "stay active")}),
        ("", set()),
    ],
)
def test_explanations_are_held_against_facts(spark, text, want):
    assert violations(spark, text) == want


def test_facts_allow_what_they_hold(spark):
    assert violations(spark, "They cancel; offer a call.", flag_types=["cancellation_intent"], recommendation="Offer a call.") == set()
    assert violations(spark, "They are upset and stay active.", flag_types=["positive_feedback"], level="low") == {("RISK_FACTOR", "upset")}
    assert violations(spark, None, numbers=None, integers=None, flag_types=None, evidence_ids=None, display_name=None) == set()
    assert violations(spark, "Score 1.", numbers=None, integers=None) == {("NUMBER", "1")}
