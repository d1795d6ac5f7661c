import random
import re
from collections import Counter

import numpy as np
import pytest

from stayline.llm import phrases as P


def brute(rows, least, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + m])) for m in range(1, 6) for i in range(len(w) - m + 1))
    frequent = {k: v for k, v in counts.items() if v >= least and len(k[1]) > 1}
    out = {}
    for (lang, w), a in frequent.items():
        inside = any(
            100 * f >= 100 * a and any(o[i : i + len(w)] == w for i in range(len(o) - len(w) + 1))
            for (other, o), f in frequent.items() if other == lang and len(o) > len(w)
        )
        if not inside:
            n = totals[lang]
            cuts = [(counts[lang, w[:k]], counts[lang, w[k:]], k) for k in range(1, len(w))]
            score, _, left, right = min((1000 * a * n // (x * y), k, x, y) for x, y, k in cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right, n))
    return {
        (lang, rank, p.decode(), -a, x, y, n, -s)
        for lang, found in out.items() for rank, (s, a, p, x, y, n) in enumerate(sorted(found)[:top], 1)
    }


def test_packing_and_permutation_are_inverted():
    rng = np.random.default_rng(1)
    for n in range(2, 6):
        ids = [rng.integers(1, 1 << P.ID_BITS, 500) for _ in range(n)]
        hi, lo = P.permute(*P.pack(ids))
        back = P.unpack(*P.restore(hi, lo))
        assert (back[:, :n] == np.stack(ids, axis=1)).all() and (back[:, n:] == 0).all()


@pytest.mark.parametrize("quotient_bytes", [1, 2])
def test_filters_lose_nothing(quotient_bytes):
    rng = np.random.default_rng(2)
    keys = rng.integers(1, 50, (4000, 2))
    hi, lo = P.permute(*P.pack([keys[:, 0], keys[:, 1]]))
    n = rng.integers(1, 900, 4000)
    want = Counter()
    for k, c in zip(map(tuple, keys.tolist()), n.tolist()):
        want[k] += c
    halves = [P.merged([(hi[s], lo[s], n[s])]) for s in (slice(0, 1500), slice(1500, None))]
    runs = [r for h in halves for r in P.encode_runs(h, quotient_bytes)]
    h, low, c = P.merged([P.decode_run(*r, quotient_bytes) for r in runs])
    ids = P.unpack(*P.restore(h, low))
    assert {tuple(i[:2]): k for i, k in zip(ids.tolist(), c.tolist())} == want


def test_collocations_equal_brute_force(spark, odd_docs):
    rng = random.Random(5)
    words = ["a", "B", "c", "d", "É", " ", "e-f"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ", ", "\n"]) for _ in range(60)), rng.choice(["en", "de", None])) for _ in range(60)]
    rows += [("x x x x x x x x", "en")] * 4 + [("one two three four five six", "und")] * 7 + [(None, "en"), ("", None), (" \t", "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS ids", "2 AS block", "3 AS n", "4 AS `a.b`")
    for least, top, how in ((5, 2000, {"block_words": 100}), (3, 20, {"quotient_bytes": 2})):
        got = {tuple(r) for r in P.collocations(df.repartition(5), least=least, top=top, **how).collect()}
        assert got == brute(rows, least, top)
    odd = [(r.text, r.lang) for r in odd_docs.select("text", "lang").collect()]
    assert {tuple(r) for r in P.collocations(odd_docs, least=2).collect()} == brute(odd, 2, 2000)


def test_no_rows(spark, no_docs):
    assert P.collocations(no_docs).collect() == []


def test_places_are_packed_in_chunks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_PLACES", 7)
    monkeypatch.setattr(P, "FILTER_SIZE", 20)
    rng = random.Random(8)
    rows = [(" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))), "en") for _ in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(2)
    assert {tuple(r) for r in P.collocations(df, least=3).collect()} == brute(rows, 3, 2000)


def test_keys_that_share_64_bits_stay_apart():
    hi, lo = np.array([5, 5, 5, 2], np.uint64), np.array([9, 1, 9, 4], np.uint64)
    h, low, n = P.merged([(hi, lo, np.array([1, 2, 3, 4])), (hi[:1], lo[:1], np.array([10]))])
    assert list(zip(h.tolist(), low.tolist(), n.tolist())) == [(2, 4, 4), (5, 1, 2), (5, 9, 14)]


def test_rows_of_blocks_are_few_and_small(spark):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randint(0, 20_000)}" for _ in range(300_000)).replace(" w7 ", ". ")
    rows = P.word_blocks(spark.createDataFrame([(text, "en")] * 2, "text string, lang string").coalesce(1)).collect()
    assert len(rows) <= 1100  # one for each of 20,001 distinct words before
    assert max(len(v) for r in rows for v in r if isinstance(v, (bytes, bytearray))) < 3 * 300_000


def test_words_over_many_blocks_equal_brute_force(spark):
    rng = random.Random(10)
    words = [*(f"w{k}" for k in range(90)), "nan", "None", "\0", "\x85", " ", "NULL"]
    langs = ["en", "a b", " ", "nan", None]
    rows = [("".join(rng.choice(words) + rng.choice(" \t.") for _ in range(200)) + "q r s. t u v q r s", rng.choice(langs)) for _ in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string").coalesce(3)
    for block_words in (10, 45):  # blocks end by their distinct words, and by their rows
        assert {tuple(r) for r in P.collocations(df, least=4, block_words=block_words).collect()} == brute(rows, 4, 2000)


@pytest.mark.parametrize("bits", [3, 12, 13, 16, 21, 22, 25])
def test_levels_count_exactly_with_ids_of_any_width(spark, bits):
    rng = np.random.default_rng(11)
    some = np.unique(np.concatenate([[1, (1 << bits) - 1], rng.integers(1, 1 << bits, 4)]))
    rows = [np.where(rng.random(400) < 0.1, 0, rng.choice(some, 400)) for _ in range(4)]
    encoded = spark.createDataFrame([(P.squeeze(r),) for r in rows], "ids binary").repartition(2)
    want = Counter()
    for r in map(np.ndarray.tolist, rows):
        want.update(tuple(r[i : i + m]) for m in range(2, 6) for i in range(len(r) - m + 1) if all(r[i : i + m]))
    bitmap = None
    for lengths in P.LEVELS:
        level = P.count_level(encoded, lengths, 3, bitmap, 8 + bits % 8, bits)
        assert {tuple(r.ids): r.f for r in level.collect()} == {k: v for k, v in want.items() if len(k) in lengths and v >= 3}
        bitmap = P._bitmap(level)


def test_bigrams_of_few_words_take_few_bytes():
    rng = np.random.default_rng(12)
    ids = [rng.integers(1, 1 << 17, 300_000) for _ in range(2)]
    f = P.merged([(*P.to_keys(ids, 2, 17), np.ones(300_000, np.int64))])
    runs = list(P.encode_runs(f, 1, P.key_bytes_of(2, 17, 1)))
    assert sum(len(r[1]) for r in runs) < 4 * len(f[-1])  # 15 bytes each before
    back = P.merged([P.decode_run(*r, 1, P.key_bytes_of(2, 17, 1)) for r in runs])
    assert all((x == y).all() for x, y in zip(f, back, strict=True))
    assert Counter(map(tuple, P.from_keys(back[:-1], 2, 17).tolist())) == Counter(set(zip(*(i.tolist() for i in ids))))


def test_numbers_as_bytes_are_inverted():
    for a in ([], [0], [1, 255, 256, 65536, (1 << 32) - 1]):
        assert P.from_planes(P.planes(np.array(a, np.int64))).tolist() == P.unsqueeze(P.squeeze(np.array(a, np.int64))).tolist() == a


@pytest.mark.parametrize("more", [0, 1, 5, 7])
def test_quotients_of_any_bits(more):
    rng = np.random.default_rng(13)
    f = P.merged([(*P.to_keys([rng.integers(1, 1 << 20, 5000) for _ in range(2)], 2, 20), rng.integers(1, 900, 5000))])
    runs = list(P.encode_runs(f, 1, 5, more))
    assert len({r[0] for r in runs}) == len(runs) <= 1 << (8 + more) and len(runs) > 0.5 * min(5000, 1 << (8 + more))
    assert all((x == y).all() for x, y in zip(f, P.merged([P.decode_run(*r, 1, 5, more) for r in runs]), strict=True))
