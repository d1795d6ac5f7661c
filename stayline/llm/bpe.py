"""Byte-level BPE over distinct words, with the ranked merges folded by Spark's higher-order functions.

1. The words (matches of the tokenizer's pattern) of all documents are counted. Of those that make at least one
   in ``COMMON_SHARE`` of all occurrences (as many words at most, whatever the input) the ``COMMON_WORDS`` most
   frequent are taken: a vocabulary of bounded size that covers over nine tenths of all occurrences.
2. Spark encodes these distinct words once: a word is an array of one-byte pieces (a byte is the Latin-1
   character of its value), the ranks of neighbouring pieces stand beside it, and ``aggregate`` merges the
   leftmost pair of the lowest rank until no pair has a rank. The rank map is one literal: an array of small
   maps, addressed by a hash of the piece, because a lookup in a map literal walks all its entries.
3. Each text is put together where it is, with the vocabulary at hand; a word outside it is merged by the same
   rule in Python (``merge_word``). Decoding joins the bytes of the ids' pieces again.

Folding all distinct words in Spark and sending each block of documents its words gave the same results, but
cost 2427 CPU seconds a GB (900 allowed) and over twice the disk: see the README.
"""

from __future__ import annotations

import base64
import json
from zlib import crc32

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pick, slices, table, text_or_empty
from .packing import cut_words

#: Longer words (in bytes) are not folded in Spark, whose steps grow with the square of a word's length: they are merged
#: where they stand, by a heap.
LONG_WORD = 64
RANK_SLOTS = 1 << 15
#: Distinct words that Spark encodes and every task has at hand, at most; each is one in COMMON_SHARE occurrences or more.
COMMON_WORDS = 300_000
COMMON_SHARE = 8_000_000
#: Different space-delimited words that a task counts or remembers at a time.
CACHE_WORDS = 250_000


def rank_table(path: str | None = None) -> dict[bytes, int]:
    """The ranks of a vocabulary file, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as a literal of one array of maps (folded once, at planning)."""
    import xxhash

    slots: list[dict[str, int]] = [{} for _ in range(RANK_SLOTS)]
    for piece, rank in ranks.items():
        word = piece.decode("latin-1")
        slots[xxhash.xxh64_intdigest(word.encode(), seed=42) & (RANK_SLOTS - 1)][word] = rank
    return F.from_json(F.lit(json.dumps(slots)), "array<map<string,int>>")


def encode_word(word: Column, ranks: Column) -> Column:
    """Ids (``array<int>``) of a word of Latin-1 coded bytes; null for null, none for an empty word."""

    def rank(piece: Column) -> Column:
        return F.get(ranks, F.xxhash64(piece).bitwiseAND(F.lit(RANK_SLOTS - 1)).cast("int"))[piece]

    def let(value: Column, body) -> Column:  # evaluates value once
        return F.get(F.transform(F.array(value), body), 0)

    def merge(state: Column, _: Column) -> Column:
        pieces, pairs = state["pieces"], state["pairs"]
        none = F.array().cast("array<int>")

        def at(i: Column) -> Column:  # the pair of pieces i and i + 1, counted from 1, becomes one piece
            merged = F.concat(F.get(pieces, i - 1), F.get(pieces, i))
            left = F.when(
                i > 1, F.concat(F.slice(pairs, F.lit(1), i - 2), F.array(rank(F.concat(F.get(pieces, i - 2), merged))))
            ).otherwise(none)
            right = F.when(
                i < F.size(pairs),
                F.concat(F.array(rank(F.concat(merged, F.get(pieces, i + 1)))), F.slice(pairs, i + 2, F.size(pairs))),
            ).otherwise(none)
            rest = F.slice(pieces, i + 2, F.size(pieces))
            return F.struct(
                F.concat(F.slice(pieces, F.lit(1), i - 1), F.array(merged), rest).alias("pieces"),
                F.concat(left, right).alias("pairs"),
            )

        best = F.array_min(pairs)
        return F.when(best.isNull(), state).otherwise(let(F.array_position(pairs, best).cast("int"), at))

    start = let(
        F.split(word, ""),
        lambda p: F.struct(
            p.alias("pieces"),
            F.transform(
                F.sequence(F.lit(0), F.size(p) - 2), lambda i: rank(F.concat(F.get(p, i), F.get(p, i + 1)))
            ).alias("pairs"),
        ),
    )
    folded = F.aggregate(F.sequence(F.lit(2), F.length(word)), start, merge)["pieces"]
    whole = rank(word)
    return (
        F.when(F.length(word) == 0, F.array().cast("array<int>"))
        .when(whole.isNotNull(), F.array(whole))
        .otherwise(F.transform(folded, rank))
    )


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges for one word in Python; long words by a heap of pairs over a linked list, n log n steps."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG_WORD:
        return _merge_long(word, ranks)
    pieces = [word[i : i + 1] for i in range(len(word))]
    none = len(ranks) + 1_000_000
    pairs = [ranks.get(a + b, none) for a, b in zip(pieces, pieces[1:])]
    while pairs:
        best = min(pairs)
        if best == none:
            break
        i = pairs.index(best)
        merged = pieces[i] + pieces[i + 1]
        pieces[i : i + 2] = [merged]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(pieces[i - 1] + merged, none)
        if i < len(pairs):
            pairs[i] = ranks.get(merged + pieces[i + 1], none)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    import heapq

    n = len(word)
    pieces: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = [*range(1, n), -1], list(range(-1, n - 1))
    heap = [(r, i, pieces[i], pieces[i + 1]) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if pieces[i] is not left or j < 0 or pieces[j] is not right:
            continue  # one of the two has been merged since
        pieces[i], pieces[j] = left + right, None
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b >= 0 and (r := ranks.get(pieces[a] + pieces[b])) is not None:
                heapq.heappush(heap, (r, a, pieces[a], pieces[b]))
    return [ranks[p] for p in pieces if p is not None]


def count_words(texts: DataFrame, pattern: str) -> DataFrame:
    """``(word, n)``: how often each word (as Latin-1 coded bytes) occurs in column ``text``, without long words."""
    import pyarrow as pa

    def run(batches):
        from collections import Counter

        import regex

        split = regex.compile(pattern).findall
        spaced: Counter[str] = Counter()

        def flush():
            words: Counter[str] = Counter()
            for x, n in spaced.items():
                for w in split(x):
                    words[w] += n
            spaced.clear()
            coded = [(c, n) for w, n in words.items() if len(c := w.encode("utf-8", "surrogatepass").decode("latin-1")) <= LONG_WORD]
            for at in range(0, len(coded), 50_000):
                part = coded[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"]
                )

        for b in slices(batches):
            for text in b.column(0).to_pylist():
                spaced.update(cut_words(text))
            if len(spaced) > CACHE_WORDS:
                yield from flush()
        yield from flush()

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(texts: DataFrame, ranks: dict[bytes, int], pattern: str, limit: int = COMMON_WORDS) -> DataFrame:
    """``(word, ids)`` of the most frequent words over all texts; ties by the word. ``ids`` are joined by commas."""
    counts = materialize(count_words(texts, pattern), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # the share bounds what is sorted: a word of so many occurrences leaves room for COMMON_SHARE words at most
    frequent = counts.where(F.col("n") >= total / COMMON_SHARE)
    most = frequent.orderBy(F.desc("n"), "word").limit(limit).select("word")
    # one variable holds the literal, which else stood (and was parsed) at every lookup
    ids = F.get(F.transform(F.array(rank_literal(ranks)), lambda table: encode_word(F.col("word"), table)), 0)
    # dealt anew: the merges of a vocabulary are worth several tasks
    return most.repartition(32, "word").select("word", F.array_join(ids, ",").alias("ids"))


def encode_documents(
    docs: DataFrame, ranks: dict[bytes, int], pattern: str,
    id_col: str = "doc_id", text_col: str = "text", common: int = COMMON_WORDS,
) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row for each input row.

    Null and empty texts have no ids (the digests are those of nothing). Null ids and repeated rows stay. An
    empty table gives an empty result. Other columns are ignored.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = common_words(rows, ranks, pattern, common).toArrow()  # COMMON_WORDS rows at most
    found = dict(zip(*(vocabulary.column(name).to_pylist() for name in ("word", "ids"))))
    shared = spark.sparkContext.broadcast((ranks, found))  # a vocabulary file and a vocabulary of fixed size
    name = crc32(b"".join(ranks)) ^ crc32("".join(sorted(found)).encode())

    def run(batches):
        from hashlib import sha256

        import regex

        split = regex.compile(pattern).findall
        by_piece, bytes_of, vocabulary, known = _vocabulary(name, shared)

        def encode(spaced: str) -> tuple[int, str, bytes]:
            ids = []
            for w in split(spaced):
                got = vocabulary.get(w)
                ids.append(got if got is not None else ",".join(map(str, merge_word(w.encode("utf-8", "surrogatepass"), by_piece))))
            joined = ",".join(ids)
            numbers = joined.split(",")
            return len(numbers), joined, b"".join(map(bytes_of.__getitem__, numbers))

        for b in slices(batches):
            counts, id_shas, byte_shas = [], [], []
            for text in b.column(1).to_pylist():
                got = []
                for w in cut_words(text):
                    x = known.get(w)
                    if x is None:
                        x = encode(w)
                        if len(known) < CACHE_WORDS:
                            known[w] = x
                    got.append(x)
                counts.append(sum([x[0] for x in got]))
                id_shas.append(sha256(",".join([x[1] for x in got]).encode()).hexdigest())
                byte_shas.append(sha256(b"".join([x[2] for x in got])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()), pa.array(byte_shas, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


_vocabularies: dict = {}


def _vocabulary(name: int, shared) -> tuple:
    """Once for each Python worker: ranks, the bytes of each id (as decimal text), the common words' ids, and the
    words that its tasks remember."""
    if name not in _vocabularies:
        _vocabularies.clear()
        ranks, found = shared.value
        words = {w.encode("latin-1").decode("utf-8", "surrogatepass"): ids for w, ids in found.items()}
        _vocabularies[name] = ranks, {str(rank): piece for piece, rank in ranks.items()}, words, {}
    return _vocabularies[name]


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), rank_table(), split_pattern())
