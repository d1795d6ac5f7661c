from collections import Counter, defaultdict
from hashlib import sha256
from itertools import combinations

import pytest
import xxhash
from stayline.functions.components import connected_components
from stayline.llm import common, exact_dedup, simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc rows [(id, fp)] -> component of each fp."""
    parent = {fp: fp for _, fp in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(parent, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for i, fp in prints:
        r = root(fp)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
    return {fp: least.get(root(fp)) for fp in parent}


@pytest.mark.parametrize("name", ["real_docs", "odd_docs", "no_docs"])
def test_near_duplicates_match_brute_force(request, name):
    docs = request.getfixturevalue(name)
    prints = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    component = brute_components(prints)
    want = Counter((i, f"{fp:016x}", component[fp]) for i, fp in prints)
    got = simhash.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(map(tuple, got.collect())) == want


def test_links_are_all_pairs_in_dense_groups(spark):
    import random

    rng = random.Random(5)
    prints = set()
    for _ in range(6):  # clusters around centres, chains, and strangers
        centre = rng.getrandbits(64)
        for _ in range(120):
            fp = centre
            for b in rng.sample(range(64), rng.choice((0, 1, 2, 3))):
                fp ^= 1 << b
            prints.add(fp)
    chain = rng.getrandbits(64)
    for k in range(30):
        chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(400)}
    rows = [(i, fp) for i, fp in enumerate(sorted(prints))]
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for _, fp in rows]
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.fingerprint_links(spark.createDataFrame(signed, "fp long")).collect()]
    assert all(0 < (a ^ b).bit_count() <= 2 for a, b in links)
    want = {frozenset(x) for x in combinations(prints, 2) if (x[0] ^ x[1]).bit_count() <= 2}
    assert {frozenset(x) for x in links} == want and len(links) == len(want)
    report = simhash.link_report(spark.createDataFrame(signed, "fp long")).first()
    assert report.pairs == report.discarded + report.refuted + report.verified
    assert report.verified >= len(want) and report.discarded > 10 * report.refuted


def test_pivot_coordinates_are_distances(spark):
    """The free coordinates and the bins are what the distances to the pivots say, and finer masks nest."""
    prints = [0, -1, 1 << 62, -(1 << 63), 123456789123456789]
    pivots = [p % (1 << 64) for p in simhash.pivots()]
    assert len(set(pivots)) == 65 + simhash.FREE_PIVOTS
    for fp, coords, d in simhash.pivot_table(spark.createDataFrame([(x,) for x in prints], "fp long")).collect():
        far = [((fp % (1 << 64)) ^ p).bit_count() for p in pivots]
        assert list(d) == far[65:]
        assert coords % (1 << 64) == sum(1 << b for b in range(64) if far[1 + b] < far[0])
    for finer, bits in zip(simhash.refinements(), (32, 48, 56)):
        assert all(m & x == m and x.bit_count() == bits for m, xs in finer.items() for x in xs)


def test_components_of_chain_star_and_repeats(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(7, 200), (3, 3), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_by_hand(docs):
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row; one row of each group is kept."""
    groups = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        text = r.text or ""
        groups["".join(c for c in text if c not in " \t\n\x0b\x0c\r")].append((-len(text), r.doc_id is None, r.doc_id or 0, r.doc_id))
    want = Counter()
    for body, members in groups.items():
        keep = min(members)
        members.remove(keep)
        for m, kept in [(keep, True), *((m, False) for m in members)]:
            want[m[3], keep[3], len(members) + 1, kept, sha256(body.encode()).hexdigest()] += 1
    return want


@pytest.mark.parametrize("name", ["real_docs", "odd_docs", "no_docs"])
@pytest.mark.parametrize("index", [{}, {"bucket_rows": 5}, {"bucket_rows": 2, "max_depth": 2}])
def test_exact_duplicates_match_brute_force(request, name, index):
    docs = request.getfixturevalue(name)
    got = exact_dedup.exact_duplicates(docs, **index)
    assert Counter(tuple(r)[:5] for r in got.collect()) == exact_by_hand(docs)


def test_ids_of_any_type_that_sorts(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x y"), ("c", "z"), ("c", "z")], "doc_id string, text string")
    got = Counter((r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs).collect())
    assert got == Counter([("b", "a", False), ("a", "a", True), (None, "a", False), ("c", "c", True), ("c", "c", False)])


def test_directory_doubles_only_where_it_must():
    depth, slots, sizes = exact_dedup.directory_of({0: 5, 1: 5, 8: 1}, 4, 5)
    assert depth == 4 and len(slots) == 16
    assert slots == sorted(slots) and slots[0] != slots[1] and len(set(slots[8:])) == 1
    assert sizes[slots[0]] == sizes[slots[1]] == 5 and sizes[slots[8]] == 1
    assert exact_dedup.directory_of({}, 4, 5) == (0, [0], [0])
    assert exact_dedup.directory_of({3: 50}, 4, 5)[0] == 4  # one prefix: split as far as the depth allows


@pytest.mark.parametrize("index", [{}, {"bucket_rows": 2, "max_depth": 1}, {"bucket_rows": 1}])
def test_index_chains_texts_of_one_key(spark, index):
    """Every text has the key 1: only comparing bytes tells them apart, in one bucket or over its overflow pages."""
    texts = ["a b", "ab", "c", "d", "c ", "", None, "d  ", "ab"] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    index = {**index, "key_of": lambda body: 1}
    rows, postings = exact_dedup.build_index(docs, **index)
    assert {r.key for r in postings.collect()} == {1} and rows.count() == 27
    entries = {(r.bucket, r.key, r.chain): bytes(r.sha) for r in postings.collect()}
    assert sorted(k[2] for k in entries) == [1, 2, 3, 4] and len(set(entries.values())) == 4
    got = exact_dedup.exact_duplicates(docs, **index)
    assert Counter(tuple(r)[:5] for r in got.collect()) == exact_by_hand(docs)


def test_owners_hold_key_ranges(real_docs):
    """Buckets are key ranges in order, and the groups depend on them."""
    _, postings = exact_dedup.build_index(real_docs, bucket_rows=20)
    ranges = defaultdict(list)
    for r in postings.collect():
        ranges[r.bucket].append(r.key % (1 << 64))
    assert len(ranges) > 5
    spans = [(min(ranges[b]), max(ranges[b])) for b in sorted(ranges)]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_spread_join_is_a_join(spark, monkeypatch):
    """A hot key (half of all rows), keys without a value, repeated rows, and null keys."""
    monkeypatch.setattr(common, "PIECE_ROWS", 10)
    rows = spark.range(0, 600, 1, 3).selectExpr("if(id % 2 = 0, 7, if(id % 5 = 0, null, id % 50)) as k", "id div 4 as v")
    rows = common.materialize(rows.union(rows.limit(50)), "spread")
    values = spark.range(0, 40).selectExpr("id as k", "concat('n', id) as name")
    got = Counter(map(tuple, common.spread_join(rows, ["k"], values).collect()))
    assert got == Counter((r.k, r.v, f"n{r.k}") for r in rows.collect() if r.k is not None and r.k < 40)
    assert common.spread_join(rows, ["k"], values.limit(0)).count() == 0


def test_released_folders_hold_no_rows(spark):
    before = common.written()
    df = common.materialize(spark.range(5).toDF("a"), "released")
    path = [p for p in common.written() if p not in before]
    assert len(path) == 1 and df.count() == 5
    common.release(spark, path)
    assert common.written() == before and spark.read.schema("a long").parquet(path[0]).count() == 0
