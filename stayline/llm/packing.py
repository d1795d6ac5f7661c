"""Vector bin packing of tokenised examples, with a dot-product heuristic.

A sequence has three limits: tokens, segments (pieces of documents) and loss-bearing tokens. Pieces wait in a
bounded pool. Of those that fit the open sequence, the one whose demand vector has the largest dot product
with the sequence's remaining room goes in, both in shares of the limits. When nothing fits, the best cut of a
waiting piece goes in; its rest waits on. A sequence whose loss or segments are used up is closed with room left. Text longer than a sequence is cut the same way, so
only the last sequence of a task is short, and that one is cut at powers of two, which need no padding.

Packing happens where the documents are: one pass over the input, no shuffle, and a pool of fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_or_empty

TOKENS = 2048
SEGMENTS = 64
#: Targets that a sequence has at most: its first token follows nothing. Only a document's first token bears no loss,
#: so a sequence can't be one document's middle alone.
LOSS = TOKENS - 1
#: Pieces that wait for a place in a task.
POOL = 256
END_ID = 1
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 300_000

_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


class Packer:
    """Packs a stream of ``(payload, tokens, loss)`` pieces; yields ``(payload, start, length, sequence, offset, loss)``.

    ``loss`` is the number of loss-bearing tokens among the piece's last tokens (prompt first, answer last). ``closed``
    counts why sequences were closed: by tokens, segments or loss.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        import numpy as np

        self.limits = np.array([tokens, segments, loss], float)
        self.tokens, self.segments, self.loss = tokens, segments, loss
        self.demand = np.zeros((pool, 3))
        self.items: list = []
        self.pool = pool
        self.sequence, self.used = 0, [0, 0, 0]
        self.closed = {"tokens": 0, "segments": 0, "loss": 0}

    def add(self, payload, tokens: int, loss: int) -> Iterator[tuple]:
        if len(self.items) == self.pool:
            yield from self._place()
        self.demand[len(self.items)] = tokens, 1, loss
        self.items.append([payload, 0, tokens, loss])

    def finish(self) -> Iterator[tuple]:
        while self.items:
            yield from self._place(ending=True)

    def _close(self, why: str) -> None:
        self.closed[why] += 1
        self.sequence, self.used = self.sequence + 1, [0, 0, 0]

    def _place(self, ending: bool = False) -> Iterator[tuple]:
        """Place pieces until one has left the pool."""
        import numpy as np

        while True:
            room = [self.tokens - self.used[0], self.segments - self.used[1], self.loss - self.used[2]]
            if ending:
                left = self.used[0] + int(self.demand[: len(self.items), 0].sum())
                if left < self.tokens:  # what is left doesn't fill a sequence: cut it at powers of two
                    room[0] = (1 << (left.bit_length() - 1)) - self.used[0]
            if room[0] <= 0 or room[1] <= 0:
                self._close("tokens" if room[0] <= 0 else "segments")
                continue
            demand = self.demand[: len(self.items)]
            worth = np.array(room) / self.limits / self.limits
            fits = (demand <= room).all(axis=1)
            if fits.any():
                k = int(np.argmax(np.where(fits, demand @ worth, -1.0)))
                yield self._put(k, int(demand[k, 0]), int(demand[k, 2]))
                self._remove(k)
                return
            # nothing fits whole: of the cuts that do, the one with the largest dot product
            free = demand[:, 0] - demand[:, 2]
            cut = np.minimum(np.minimum(room[0], demand[:, 0] - 1), free + room[2])
            lost = np.maximum(0, cut - free)
            score = np.where(cut > 0, cut * worth[0] + worth[1] + lost * worth[2], -1.0)
            k = int(np.argmax(score))
            if score[k] < 0:
                self._close("loss")
                continue
            take, spent = int(cut[k]), int(lost[k])
            payload, start, tokens, loss = self.items[k]
            yield self._put(k, take, spent)
            self.items[k] = [payload, start + take, tokens - take, loss - spent]
            self.demand[k] = tokens - take, 1, loss - spent

    def _put(self, k: int, tokens: int, loss: int) -> tuple:
        payload, start = self.items[k][:2]
        placed = payload, start, tokens, self.sequence, self.used[0], loss
        self.used = [self.used[0] + tokens, self.used[1] + 1, self.used[2] + loss]
        return placed

    def _remove(self, k: int) -> None:
        last = len(self.items) - 1
        self.items[k] = self.items[last]
        self.demand[k] = self.demand[last]
        self.items.pop()


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level tokenizer files write bytes, as their published rule builds them."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class WordEncoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, one distinct word at a time.

    The strings of the file's added tokens are found first, as the library does; with ``specials_as_text`` (its
    ``encode_special_tokens``) they are ordinary text. The pattern never joins characters across a space that a
    non-space follows, so the text between them is cut there and each different word of a batch is encoded once. Words
    that come early are remembered, up to a bound. New words are encoded many in one string, and the ids are dealt
    back by the bytes that they stand for. The merges run in tiktoken with the file's vocabulary as ranks, which gives
    the same ids at a third of the time; ``tests/llm`` holds all this against the tokenizers library on whole texts.
    """

    def __init__(self, tokenizer_json: str, words: int = CACHE_WORDS, specials_as_text: bool = False):
        import json

        import numpy as np
        import public_tokenizers
        import tiktoken

        spec = json.loads(tokenizer_json)
        added = {t["content"]: t for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added.values()):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {} if specials_as_text else {c: int(t["id"]).to_bytes(4, "little") for c, t in added.items()}
        longest_first = sorted(self.special, key=lambda c: (-len(c), c))
        self.find_special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.special else None
        alphabet = byte_alphabet()
        ranks = {
            bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added
        }
        self.encoding = tiktoken.Encoding(
            "file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.words, self.known = words, {}
        self.id_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.id_bytes[i] = len(token)

    def _ids(self, text: str):
        import numpy as np

        return np.array(self.encoding.encode_ordinary(text), "<u4")

    def _encode_new(self, words: list[str]) -> dict[str, bytes]:
        import numpy as np

        out, spaced = {}, []
        for w in words:
            if w[0] == " ":
                spaced.append(w)
            else:  # the first word of a text has no space to part it from others
                out[w] = self._ids(w).tobytes()
        for at in range(0, len(spaced), 2000):
            group = spaced[at : at + 2000]
            ids = self._ids("".join(group))
            ends = np.cumsum([len(w.encode("utf-8", "surrogatepass")) for w in group])
            cuts = (np.searchsorted(np.cumsum(self.id_bytes[ids]), ends) + 1) * 4
            raw, start = ids.tobytes(), 0
            for w, cut in zip(group, cuts.tolist()):
                out[w] = raw[start:cut]
                start = cut
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        cut = [cut_words(t) if self.find_special is None or not self.find_special.search(t) else None for t in texts]
        known = self.known
        new = self._encode_new([w for w in set().union(*(c for c in cut if c)) if w not in known])
        if len(known) + len(new) <= self.words:
            known.update(new)
        get = known.get
        return [
            self._around_specials(text) if words is None else b"".join([get(w) or new[w] for w in words])
            for text, words in zip(texts, cut)
        ]

    def _around_specials(self, text: str) -> bytes:
        """Ids of a text with added tokens: what stands between them is encoded by itself."""
        pieces = self.find_special.split(text)
        return b"".join(self.special[p] if k % 2 else self._ids(p).tobytes() for k, p in enumerate(pieces))


#: White space as the pattern's ``\s`` has it.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))


_SPACE_BEFORE_SPACE = re.compile(r" (?:\s|$)")


def cut_words(text: str) -> list[str]:
    """Cut before each space that a non-space follows; the parts joined give the text."""
    if not text:
        return []
    parts = text.split(" ")
    if parts[0] and not _SPACE_BEFORE_SPACE.search(text):
        return [parts[0], *[" " + p for p in parts[1:]]]
    words = [parts[0]] if parts[0] else []
    for part in parts[1:]:
        if (part and part[0] not in _WHITE) or not words:
            words.append(" " + part)
        else:
            words[-1] += " " + part
    return words


def pack_documents(
    docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text",
    tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, end_id: int = END_ID,
    prompt_col: str | None = None, specials_as_text: bool = False,
) -> DataFrame:
    """One row for each piece: its place in the document, its sequence and offset there, its loss-bearing tokens.

    ``prompt_col`` names a text that comes before ``text_col`` (instruction data): it is encoded by itself, its tokens
    stand first in the document and bear no loss. A null prompt is an empty one.

    Null and empty texts are documents of the end id alone. Repeated rows are packed as often as they come,
    null ids like any other; an empty table gives an empty result; other columns are ignored. The first token
    of a document bears no loss, since nothing precedes it. Sequence ids are unique over all tasks.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    prompt = text_or_empty(prompt_col) if prompt_col else F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(text_col).alias("text"), prompt.alias("prompt"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    vocabulary = spark.sparkContext.broadcast(tokenizer_json)  # one file of a fixed vocabulary
    name = crc32(tokenizer_json.encode()), specials_as_text
    end = end_id.to_bytes(4, "little")
    names = ["doc_id", *(part.split()[0] for part in _SCHEMA.split(", "))]
    arrow = [pa.int64()] * len(names[1:])

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoder(name, vocabulary)
        first = TaskContext.get().partitionId() << 32
        packer = Packer(tokens, segments, loss)
        id_type = None

        def table_of(placed):
            cols = list(zip(*placed))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type), *(pa.array(c, t) for c, t in zip(cols[1:], arrow))], names=names
            )

        def row(placed):
            (doc, ids), start, length, sequence, offset, bearing = placed
            part = ids[4 * start : 4 * (start + length)]
            return doc, start, length, crc32(part), len(ids) // 4, first + sequence, offset, bearing

        out = []
        for b in slices(batches):
            id_type = b.column(0).type
            texts = encoder.encode(b.column(1).to_pylist())
            prompts = encoder.encode(b.column(2).to_pylist()) if prompt_col else [b""] * len(texts)
            for doc, prompt_ids, ids in zip(b.column(0).to_pylist(), prompts, texts):
                ids = prompt_ids + ids + end
                n = len(ids) // 4
                out += map(row, packer.add((doc, ids), n, n - max(1, len(prompt_ids) // 4)))
            if out:
                yield table_of(out)
                out = []
        out = [row(p) for p in packer.finish()]
        if out:
            yield table_of(out)

    return rows.mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")


_encoders: dict = {}


def _encoder(name: tuple[int, bool], vocabulary) -> WordEncoder:
    """The encoder of this Python worker: tasks that follow each other in a worker share what it remembers."""
    if name not in _encoders:
        _encoders.clear()
        _encoders[name] = WordEncoder(vocabulary.value, specials_as_text=name[1])
    return _encoders[name]


def tokenizer_file(path: str | None = None) -> str:
    """The tokenizer's JSON, read on the driver; executors get it by broadcast."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
