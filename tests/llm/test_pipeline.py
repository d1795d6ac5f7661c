"""The corpus pipeline against the same stages by brute force, and the entry points."""

import re
import sys
from collections import Counter, defaultdict
from zlib import crc32

import __spark_entry__ as entry
import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from stayline.llm.common import written
from stayline.llm import pii

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_dedup import brute_components, brute_fingerprint  # noqa: E402
from test_text import brute_verdict  # noqa: E402

SF = "/root/testdata/sf0.001"


SPACE = " \t\n\x0b\x0c\r"
late = lambda i: (i is None, i or 0)


def one_each(rows, group, rank):
    """The first of each group; rows of one group and rank are alike."""
    best = {}
    for r in rows:
        k = group(r)
        if k not in best or rank(r) < rank(best[k]):
            best[k] = r
    return list(best.values())


def by_hand(rows):
    """``(doc_id, text)`` that the first three stages leave, without the code of any stage."""
    rows = [r for r in rows if brute_verdict(r[1]) == "kept"]
    rows = one_each(rows, lambda r: "".join(x for x in r[1] if x not in SPACE), lambda r: (-len(r[1]), *late(r[0])))
    prints = [(r, brute_fingerprint(r[1])) for r in rows]
    root = brute_components([(k, fp) for k, (_, fp) in enumerate(prints)])
    return [r for r, _ in one_each(prints, lambda x: root[x[1]], lambda x: late(x[0][0]))]


#: The forms of private values in the tables, written down anew.
PRIVATE = [
    r"[A-Za-z0-9_.%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    r"(?<![\w.-])(?:\d[ -]?){12,18}\d(?![\w-])",
    r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])",
    r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-])",
    r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\w/-])",
]


def check_private(old, new, names):
    """Only letters and digits inside private values change, and equal values get equal names everywhere."""
    spans = sorted((m.start(), m.end()) for p in PRIVATE for m in re.finditer(p, old))
    shape = lambda t: re.sub(r"[^\W_]", "x", t)
    if "@" not in old and not re.search(r"\d\.\d", old):
        assert shape(old) == shape(new)
        changed = {k for k, (a, b) in enumerate(zip(old, new)) if a != b}
        assert all(any(s <= k < e for s, e in spans) for k in changed)
    mails, new_mails = (re.findall(PRIVATE[0], t) for t in (old, new))
    for a, b in zip(mails, new_mails):
        assert a != b and a.split("@")[1] == b.split("@")[1] and names.setdefault(a, b) == b
    for date in re.findall(r"(?<![\w./-])(?:19|20)\d\d-(?:0[1-9]|1[0-2])-(?:0[1-9]|1\d|2[0-8])(?![\w/-])", old):
        assert date not in new or old.count(date) < 3
    return bool(spans)


def test_pipeline_matches_brute_force(spark):
    from tokenizers import Tokenizer

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = dict(by_hand(rows))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    spark.conf.set(pii.KEY_SETTING, "key of this test")
    try:
        docs, wrote = spark.read.parquet(f"{SF}/documents.parquet"), len(written())
        for _, stage in corpus_pipeline.STAGES[:4]:
            docs = corpus_pipeline.materialize(stage(spark, docs, SF), "by-stage")
        done = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
        pieces = corpus_pipeline.run(spark, SF).collect()
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert set(done) == set(want)
    names: dict[str, str] = {}
    assert sum(check_private(old, done[i][0], names) for i, old in want.items()) > 5 and names
    assert all(len(text) == n for text, n in done.values())
    got, sequences, crc = Counter(), defaultdict(list), {}
    for r in pieces:
        ids = crc.setdefault(r.doc_id, [*tokenizer.encode(done[r.doc_id][0], add_special_tokens=False).ids, 1])
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == crc32(b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length]))
        got[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == {i: len(x) for i, x in crc.items()} and set(got) == set(want)
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    # run() leaves two folders with rows: the last stage's input, and nothing else of its own
    left = written()[wrote:]
    assert sum(p.rsplit("/", 1)[1].startswith(("quality", "exact-d", "near-d", "private")) for p in left) == 1


def test_null_and_repeated_ids_are_judged_by_row(spark, real_docs, odd_docs, tmp_path):
    """Rows of one id, or of none, don't readmit each other, one row of each group of copies stays, and columns that
    are called like an operator's own pass through."""
    good = sorted((r.text for r in real_docs.collect() if brute_verdict(r.text) == "kept"), key=lambda t: (len(t), t))
    a, b, c = good[-1], good[-3], good[-5]
    near = a + " x"
    rows = [(20, a), (20, a), (20, b), (None, c), (None, c), (None, "too short"), (21, "too short"), (21, c), (20, a.replace(" ", "  ")), (None, near), (22, b)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], odd_docs.schema.simpleString()[7:-1].split(",fp")[0])
    for n in odd_docs.columns[5:]:
        more = more.withColumn(n, F.lit("clash"))
    odd = odd_docs.union(more)
    for n in ("n_replaced", "bucket", "row", "rep", "chain", "coords", "mask", "d", "prompt", "file", "at", "content", "blank"):
        odd = odd.withColumn(n, F.lit("clash"))
    odd.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = [(i, t) for i, t in rows if brute_verdict(t) == "kept"]
    assert (None, "too short") not in want and len(want) > 5
    docs = corpus_pipeline.materialize(corpus_pipeline.quality_stage(spark, docs, ""), "odd-quality")
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want)
    docs = corpus_pipeline.materialize(corpus_pipeline.exact_stage(spark, docs, ""), "odd-exact")
    want = one_each(want, lambda r: "".join(x for x in r[1] if x not in SPACE), lambda r: (-len(r[1]), *late(r[0])))
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want)
    docs = corpus_pipeline.materialize(corpus_pipeline.near_stage(spark, docs, ""), "odd-near")
    want = by_hand(rows)
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want)
    docs = corpus_pipeline.materialize(corpus_pipeline.private_stage(spark, docs, ""), "odd-private")
    assert docs.columns == columns and Counter(r.doc_id for r in docs.collect()) == Counter(i for i, _ in want)
    assert {r.n_replaced for r in docs.collect()} == {"clash"}
    pieces = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in want}


def test_empty_tables_give_empty_results(spark, no_docs, tmp_path):
    no_docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_stages_take_names_with_dots(spark, odd_docs):
    docs = odd_docs.selectExpr("*", "1 AS `a.b`", "'x' AS `text.x`")
    for stage in (corpus_pipeline.quality_stage, corpus_pipeline.private_stage):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and all(r["a.b"] == 1 for r in got.collect())


def test_runs_in_threads_leave_each_other_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    held = corpus_pipeline.materialize(spark.range(10), "held")
    with ThreadPoolExecutor(2) as pool:
        counts = list(pool.map(lambda _: corpus_pipeline.run(spark, SF).count(), range(2)))
    assert counts[0] == counts[1] > 0 and held.count() == 10
