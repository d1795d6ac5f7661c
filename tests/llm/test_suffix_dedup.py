import random

import pytest

from stayline.llm import suffix_dedup as S
from stayline.llm.common import written


def brute(rows):
    first = {}
    for i, text in rows:
        if i is not None:
            raw = (text or "").encode()
            for p in range(len(raw) - 49):
                w = raw[p : p + 50]
                first[w] = min(i, first.get(w, i))
    out = []
    for i, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        if i is not None:
            for p in range(len(raw) - 49):
                if first[raw[p : p + 50]] < i:
                    gone[p : p + 50] = [True] * 50
        runs = sum(g and not before for g, before in zip(gone, [False, *gone]))
        out.append((i, len(raw), sum(gone), runs, bytes(b for b, g in zip(raw, gone) if not g)))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in df.collect()), key=repr)


def test_suffix_arrays_equal_sorting():
    rng = random.Random(4)
    for size, letters in ((0, 1), (1, 1), (40, 1), (200, 2), (300, 3), (500, 200)):
        for _ in range(20):
            s = [rng.randint(1, letters) for _ in range(size)] + [0]
            assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in ([1, 2] * 50 + [0], [2, 1] * 50 + [0], [3, 1, 2, 3, 1, 2, 2] * 9 + [0]):
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_groups_share_their_lyndon_prefix():
    rng = random.Random(9)
    s = [rng.randint(1, 2) for _ in range(200)] + [0]
    groups, previous = S.lyndon_groups(s)

    def prefix(i):
        after = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), len(s))
        return tuple(s[i:after])

    prefixes = [{prefix(i) for i in g} for g in groups]
    assert all(len(p) == 1 for p in prefixes)
    flat = [p.pop() for p in prefixes]
    assert flat == sorted(set(flat))
    assert all(p == max((j for j in range(i) if s[j:] < s[i:]), default=-1) for i, p in enumerate(previous))


@pytest.mark.parametrize("block", [1 << 18, 500])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    rng = random.Random(block)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(6)] + ["x" * 300, "ab" * 200]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(passages)[rng.randint(0, 30) :]]
        rng.shuffle(parts)
        rows.append((rng.randint(0, 40), " ".join(parts)))
    rows += [rows[3], (None, rows[4][1]), (None, rows[4][1]), (99, None), (98, ""), (97, rows[5][1]), (96, "x" * 49), (95, "x" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS name", "2 AS body", "3 AS `a.b`", "4 AS digest")
    assert found(S.remove_repeats(df.repartition(3))) == brute(rows)


def test_odd_tables(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert found(S.remove_repeats(odd_docs)) == brute(rows)
    assert S.remove_repeats(no_docs).collect() == []


def test_real_documents(real_docs):
    rows = [(r.doc_id, r.text) for r in real_docs.select("doc_id", "text").collect()]
    got = found(S.remove_repeats(real_docs))
    assert got == brute(rows) and sum(r[2] for r in got) > 0


def test_only_pieces_that_may_repeat_are_ordered(monkeypatch):
    rng = random.Random(11)
    text = lambda n: bytes(rng.choice(b"abcd ") for _ in range(n))
    cores, ordered = [text(70) for _ in range(20)], []
    rows = [
        (k, rng.randint(0, 9), (text(30) + core[rng.randint(0, 15) :] + text(30))[:113])
        for k, core in enumerate(cores) for _ in range(4)
    ]
    rows += [(k, 50 + k, text(113)) for k in range(20)]
    first = {}
    for name, i, c in rows:
        for p in range(len(c) - 49):
            first[name, c[p : p + 50]] = min(i, first.get((name, c[p : p + 50]), i))
    want = {k: sum(1 << p for p in range(len(c) - 49) if first[name, c[p : p + 50]] < i) for k, (name, i, c) in enumerate(rows)}
    plain = S.equal_windows
    monkeypatch.setattr(S, "equal_windows", lambda contexts: ordered.extend(contexts) or plain(contexts))
    assert S.repeated_windows(rows) == {k: m for k, m in want.items() if m}
    assert 0 < sum(map(len, ordered)) < sum(len(c) for _, _, c in rows) * 0.7


def test_a_common_window_is_open_once_in_a_block(spark):
    line = "".join(chr(97 + k * k % 23) for k in range(60))
    rows = [(1, i, 0, 5, (line + f"{i:03}" * 17).encode()) for i in range(300)]
    df = spark.createDataFrame(rows, "name long, doc_id long, digest long, lo int, context binary").coalesce(1)
    members = S.window_members(df).collect()
    common = [r for r in members if r.window is not None and bytes(r.window) in line.encode()]
    told = {r.doc_id: r.mask for r in members if r.window is None}
    assert len(common) < 11 * 300 / 2
    assert all(told.get(r.doc_id, 0) >> r.start & 1 == 0 for r in members if r.window is not None)


def test_texts_of_contexts_are_released(spark, real_docs):
    before = set(written())
    S.remove_repeats(real_docs)
    left = set(written()) - before
    assert left and not any("ordered-contexts" in x for x in left)
