import numpy as np
import pytest

from stayline.llm import vector_codes as V

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, entries, rounds):
    """Everything in Python integers."""
    import math

    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    parts = [[v[p * w : (p + 1) * w] for _, v in kept] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for part, book in zip(parts, books):
            at = [near(x, book)[1] for x in part]
            for k in set(at):
                mine = [x for x, j in zip(part, at) if j == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = []
    for n, (i, _) in enumerate(kept):
        found = [near(part[n], book) for part, book in zip(parts, books)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def test_limbs_give_exact_products():
    rng = np.random.default_rng(7)
    x, y = rng.integers(-(1 << 27), 1 << 27, (50, 16)), rng.integers(-(1 << 27), 1 << 27, (30, 16))
    exact = np.array([[sum(int(a) * int(b) for a, b in zip(r, s)) for s in y] for r in x])
    for bits in (None, 3, 10):
        assert (V.exact_dots(x, y, bits) == exact).all()
    assert (sum(limb.astype(np.int64) << (5 * k) for k, limb in enumerate(V.limbs(x, 5))) == x).all()
    assert 16 * 4 ** V.limb_bits(16) < 1 << 53


def test_ties_go_to_the_first_entry():
    book = np.array([[5, 5], [1, 1], [1, 1]])
    index, far = V.nearest(np.array([[1, 1], [3, 3]]), book)
    assert index.tolist() == [1, 0] and far.tolist() == [0, 8]


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 40, 8).astype(np.float32).tolist(), int(i % 3)) for i in range(120)]
    rows += [(5, rows[5][1], None), (5, rows[5][1], None), (None, rows[7][1], 1), (200, None, 1), (201, [1.0] * 7 + [None], 1)]
    rows += [(202, [float("nan")] * 8, 2), (203, [float("inf")] * 8, 2), (204, [-60000.5] * 8, 2), (205, [0.0] * 8, None)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "'clash' AS code", "'clash' AS v", "'clash' AS error", "1 AS `a.b`")
    coded, books = V.vector_codes(df, entries=16, rounds=4)
    expected, wanted = brute(rows, 16, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.vec_id, r.code, r.error) for r in coded.collect()), key=key) == sorted(expected, key=key)
    assert [b.tolist() for b in books] == wanted


def test_empty_and_refused_tables(spark):
    coded, books = V.vector_codes(spark.createDataFrame([(1, None, 2)], KIND))
    assert coded.collect() == [] and books == []
    with pytest.raises(ValueError, match="equal parts"):
        V.vector_codes(spark.createDataFrame([(1, [1.0] * 6, 2)], KIND))
