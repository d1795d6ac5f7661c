"""What retention keeps, which model replies are refused, and which keys headers get."""

import random
from datetime import datetime, timedelta

import pytest

from stayline.operators import quality as Q
from stayline.operators import routing
from stayline.operators import support as T

NOW = datetime(2025, 6, 30)


@pytest.mark.parametrize("ttl, keep", [(30, 2), (30, 5), (0, 3), (30, 0), (10, 1000)])
def test_retention_equals_brute_force(spark, ttl, keep):
    rng = random.Random(ttl + keep)
    day = lambda: rng.choice([None, NOW - timedelta(days=rng.randint(0, 60))])
    states = ["queued", "running", "finished", "stopped", "interrupted", "failed"]
    rows = [(f"r{i}", rng.choice(states), NOW - timedelta(days=rng.randint(0, 60)), day(), day()) for i in range(60)]
    runs = spark.createDataFrame(rows, "run_id string, status string, created_at timestamp, started_at timestamp, finished_at timestamp")
    at = {r[0]: r[4] or r[3] or r[2] for r in rows}
    want = {r[0]: "expired" for r in rows if ttl and r[1] in states[3:] and at[r[0]] < NOW - timedelta(days=ttl)}
    left = sorted(((at[r[0]], r[0]) for r in rows if r[0] not in want and r[1] not in states[:2]), reverse=True)
    want |= {i: "beyond newest" for _, i in left[keep:]} if keep else {}
    assert {r.run_id: r.reason for r in Q.retention(runs, "2025-06-30", ttl, keep).collect()} == want


def test_runs_under_way_take_no_place(spark):
    rows = [("a", "running", 4), ("b", "running", 3), ("c", "finished", 2), ("d", "finished", 1)]
    runs = spark.createDataFrame([(i, s, NOW - timedelta(days=9 - d), None, None) for i, s, d in rows], "run_id string, status string, created_at timestamp, started_at timestamp, finished_at timestamp")
    assert Q.retention(runs, "2025-06-30", keep=2).collect() == []


def test_models_in_use_stay(spark):
    models = spark.createDataFrame([(f"m{i}", NOW - timedelta(days=i)) for i in range(6)], "model_version string, saved_at timestamp")
    runs = spark.createDataFrame([("m4",), (None,)], "model_version string")
    assert {r[0] for r in Q.model_retention(models, runs, 2).collect()} == {"m2", "m3", "m5"}
    assert Q.model_retention(models, runs, 0).collect() == []


def flag(**changes):
    import json

    base = {"flag_type": "other", "severity": "low", "signal_strength": "weak", "message_id": "m1"} | changes
    return json.dumps({"risk_flags": [{k: v for k, v in base.items() if v is not ...}]})


REPLIES = [
    (flag(), "ok"), ("```json\n" + flag() + "\n```", "ok"), ("{}", "ok"), ('{"sentiment": null, "risk_flags": null}', "ok"),
    ('{"sentiment": {"label": "mixed", "score": null, "confidence": 0.5}, "urgency_level": "high"}', "ok"),
    ("", "INVALID_JSON"), (None, "INVALID_JSON"), ("{", "INVALID_JSON"), ("[1, 2]", "BAD_SHAPE"), ('"text"', "BAD_SHAPE"), ("null", "BAD_SHAPE"),
    ('{"risk_flags": "no"}', "BAD_SHAPE"), ('{"risk_flags": [1]}', "BAD_SHAPE"), ('{"risk_flags": [null]}', "BAD_SHAPE"),
    ('{"sentiment": "good"}', "BAD_SHAPE"), ('{"key_themes": "price"}', "BAD_SHAPE"), ('{"sentiment": {"label": null}}', "BAD_LABEL"),
    ('{"sentiment": {"label": "angry"}}', "BAD_LABEL"), ('{"sentiment": {"score": 1.5}}', "BAD_SCORE"),
    ('{"sentiment": {"confidence": 7}}', "BAD_SCORE"), ('{"sentiment": {"confidence": null}}', "BAD_SCORE"),
    ('{"urgency_level": "banana"}', "BAD_URGENCY"), ('{"urgency_level": null}', "BAD_URGENCY"), (flag(signal_strength="GIGANTIC"), "BAD_FLAG"),
    (flag(confidence=7), "BAD_FLAG"), (flag(confidence="high"), "BAD_FLAG"), (flag(severity=...), "BAD_FLAG"), (flag(flag_type="boredom"), "BAD_FLAG"),
    (flag(message_id="m2"), "UNCITED_FLAG"), (flag(message_id=...), "UNCITED_FLAG"), (flag(message_id=1), "UNCITED_FLAG"),
]


def test_replies_are_refused(spark):
    replies = spark.createDataFrame([(f"t{i}", r) for i, (r, _) in enumerate(REPLIES)], "thread_id string, raw_reply string")
    rows = [(f"t{i}", m, role) for i in range(len(REPLIES)) for m, role in (("m1", "customer"), ("m2", "agent"), ("1", "customer"))]
    messages = spark.createDataFrame(rows, "thread_id string, message_id string, role string")
    got = {r.thread_id: r.code for r in T.check_model_replies(replies, messages).collect()}
    assert [(REPLIES[i][0], got[f"t{i}"]) for i in range(len(REPLIES))] == REPLIES


def test_keys_are_unique(spark):
    rng = random.Random(8)
    names = ["a", "A ", "a_2", "a 3", "a", "planTier", "plan_tier", "%%", "", "9x", "aB2C", "feature", "x" * 60, "x" * 61]
    tables = {f"t{k}": [rng.choice(names) + " " * i for i in range(25)] for k in range(6)}
    rows = [(t, i, c) for t, cs in tables.items() for i, c in enumerate(cs)]
    columns = spark.createDataFrame(rows, "table_name string, position int, column_name string")
    mapped = spark.createDataFrame([("t0", tables["t0"][3], "feature.a_2"), ("t0", tables["t0"][4], "tenure")], "table_name string, column_name string, target_field string")
    got = {(r.table_name, r.position): r.key for r in routing.feature_candidates(columns, mapped=mapped).collect()}
    stems = {"a": "a", "A": "a", "a_2": "a_2", "a 3": "a_3", "planTier": "plan_tier", "plan_tier": "plan_tier", "%%": "feature", "": "feature", "9x": "f_9x", "aB2C": "a_b2_c", "feature": "feature"}
    for t, cs in tables.items():
        taken = {"a_2"} if t == "t0" else set()
        for i, c in enumerate(cs):
            if t == "t0" and i in (3, 4):
                assert got.get((t, i)) == ("a_2" if i == 3 else None)
                continue
            stem = stems.get(c.strip(), "x" * 48)
            key = next(k for k in [stem, *(f"{stem}_{n}" for n in range(2, 99))] if k not in taken)
            taken.add(key)
            assert got[t, i] == key


def test_only_confirmed_mappings_supersede(spark):
    rows = [("m1", "h", True, None), ("m2", "h", False, "m1"), ("m3", "g", True, None), ("m4", "g", True, "m3")]
    mappings = spark.createDataFrame(rows, "mapping_id string, headers_hash string, confirmed boolean, supersedes string")
    assert {r.mapping_id for r in routing.active_mappings(mappings).collect()} == {"m1", "m4"}
