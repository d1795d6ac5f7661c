from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import public_tokenizers
import pytest
import tiktoken
from stayline.llm import bpe, packing


@pytest.mark.parametrize("name", ["real_docs", "odd_docs", "no_docs"])
def test_packing_places_every_id_once(request, name):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids_of = Counter()
    whole = {}
    for r in docs.select("doc_id", "text").collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        ids_of[r.doc_id] += len(ids)
        whole.setdefault(r.doc_id, []).append(b"".join(i.to_bytes(4, "little") for i in ids))
    rows = packing.pack_documents(docs, packing.tokenizer_file()).collect()
    placed, sequences = Counter(), defaultdict(list)
    for r in rows:
        placed[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        assert any(
            len(x) // 4 == r.doc_tokens and crc32(x[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32
            for x in whole[r.doc_id]
        )
    assert placed == ids_of
    loss = Counter()
    for r in rows:
        loss[r.sequence_id] += r.loss_tokens
        assert r.loss_tokens == r.length - (r.start == 0)
    assert max(loss.values(), default=0) <= packing.LOSS
    for sequence, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and len(parts) <= packing.SEGMENTS
        # tasks end with powers of two; only a sequence without room for loss is closed one token short
        assert at & (at - 1) == 0 or (at == 2047 and loss[sequence] == packing.LOSS)


def test_packer_keeps_all_three_limits():
    import random

    rng = random.Random(3)
    packer = packing.Packer(tokens=100, segments=5, loss=60, pool=16)
    items = [(k, t := rng.choice((1, 3, 20, 90, 250)), rng.randint(0, t)) for k in range(300)]
    placed = [p for item in items for p in packer.add(*item)] + list(packer.finish())
    use = defaultdict(lambda: [0, 0, 0])
    pieces = defaultdict(list)
    for k, start, length, sequence, offset, loss in placed:
        assert offset == use[sequence][0]
        use[sequence] = [a + b for a, b in zip(use[sequence], (length, 1, loss))]
        pieces[k].append((start, length, loss))
    assert all(a <= 100 and b <= 5 and c <= 60 for a, b, c in use.values())
    for k, tokens, loss in items:
        at = 0
        for start, length, _ in sorted(pieces[k]):
            assert start == at
            at += length
        assert at == tokens and sum(x[2] for x in pieces[k]) == loss


def test_each_limit_closes_sequences():
    def run(items, **limits):
        packer = packing.Packer(**limits)
        placed = [p for item in items for p in packer.add(*item)] + list(packer.finish())
        return packer.closed, len({p[3] for p in placed})

    whole = [(k, 50, 49) for k in range(40)]
    assert run(whole, tokens=100, segments=64, loss=99)[0] == {"tokens": 19, "segments": 0, "loss": 0}
    assert run(whole, tokens=100, segments=64, loss=40)[0]["loss"] > 30
    assert run([(k, 2, 1) for k in range(400)], tokens=100, segments=5, loss=99)[0]["segments"] > 70
    # answers and prompts in turn: a sequence takes prompts once its loss is used up, so none is closed with room left
    mixed = [(k, 50, 50 if k % 2 else 0) for k in range(40)]
    assert run(mixed, tokens=100, segments=64, loss=50)[0]["loss"] == 0
    # one long document bears loss on every token but its first: the limit of 2047 targets cuts it short of 2048
    assert run([(0, 10_000, 9_999)], tokens=2048, segments=64, loss=2047)[0]["loss"] >= 3


def test_prompts_bear_no_loss(spark):
    rows = [(1, "question one?", "an answer"), (2, None, "only text"), (3, "only a prompt", None), (4, "p " * 3000, "a " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, prompt string, text string")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(packing.tokenizer_file())
    loss, whole = Counter(), Counter()
    for r in packing.pack_documents(docs, packing.tokenizer_file(), prompt_col="prompt").collect():
        loss[r.doc_id] += r.loss_tokens
        whole[r.doc_id] += r.length
    for i, prompt, text in rows:
        a, b = (len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in (prompt, text))
        assert whole[i] == a + b + 1 and loss[i] == a + b + 1 - max(a, 1)


@pytest.mark.parametrize("as_text", [False, True])
def test_cut_words_joins_again_and_never_changes_ids(odd_rows, as_text):
    from tokenizers import Tokenizer

    tok = packing.WordEncoder(packing.tokenizer_file(), specials_as_text=as_text)
    library = Tokenizer.from_str(packing.tokenizer_file())
    library.encode_special_tokens = as_text
    special = ["hello <|endoftext|> world", " <|endoftext|> a<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n x"]
    for text in [r[1] or "" for r in odd_rows] + ["  a  b ", "\n x  y\x1c z", " ", "don't  'll we'd\r\n\r\n 4 5", *special]:
        assert "".join(packing.cut_words(text)) == text
        ids = library.encode(text, add_special_tokens=False).ids
        assert tok.encode([text])[0] == b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_table(), special_tokens={})


@pytest.mark.parametrize("name", ["real_docs", "odd_docs", "no_docs"])
def test_bpe_matches_the_library_and_round_trips(request, encoding, name):
    docs = request.getfixturevalue(name)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = encoding.encode_ordinary(r.text or "")
        joined = sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[r.doc_id, len(ids), joined, sha256((r.text or "").encode()).hexdigest()] += 1
    got = bpe.encode_documents(docs, bpe.rank_table(), bpe.split_pattern(), common=500 if name == "odd_docs" else bpe.COMMON_WORDS)
    assert Counter(map(tuple, got.collect())) == want


def test_long_words_merge_like_short_ones(encoding):
    ranks = bpe.rank_table()
    for word in ("a" * 3000, "thethethe" * 50, "xyzzy" * 40, "é" * 100, "thanedble", "Größenordnung", "q"):
        assert bpe.merge_word(word.encode(), ranks) == encoding.encode_ordinary(word)
