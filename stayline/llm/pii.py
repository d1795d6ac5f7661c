"""Personal data replaced by format-preserving Feistel pseudonyms.

Validated values (card numbers by their check digit, dates by the calendar, addresses and phone numbers by
their form) are mapped by a keyed permutation of all values of their format. Equal values get equal
pseudonyms in every document, and the key's holder can undo them. The permutation is E, then one step, then
E's inverse, for a Feistel network E with cycle walking: that is one cycle over the whole domain, so no value
keeps its own name.
"""

from __future__ import annotations

import bisect
import datetime
import re
import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, slices, table

ROUNDS = 8
#: Session setting with the key, as text; Spark hides values of settings that are called secret.
KEY_SETTING = "spark.stayline.pseudonym.secret"
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
#: A run of digit groups: the cards in it are found by ``card_spans`` and ``cards_among``.
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-]|\.\d)")
PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w.+-])\+\d{8,15}(?!\w)")
IPV4 = re.compile(r"(?<![\w.-])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w-]|\.\d)")
SOCIAL = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)")
DATE = re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?!(?![Tt]\d)[\w/-]|\.\d)")
#: Group lengths that only cards have; one group of 13 to 19 digits is a layout too.
LAYOUTS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
#: One cheap look for anything that the patterns above could match: each match holds an @ or a digit and six of these.
HINT = re.compile(r"@|\d[\d ()./-]{6}")


class Feistel:
    """Keyed permutations of 0 .. size - 1, one for each (kind, size)."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = key, rounds

    def _round(self, tweak: bytes, r: int, value: int, modulus: int) -> int:
        from hashlib import blake2b

        data = tweak + b"%d|%d" % (r, value)
        return int.from_bytes(blake2b(data, key=self.key[:64], digest_size=32).digest(), "big") % modulus

    def _shape(self, size: int) -> tuple[int, int]:
        from math import isqrt

        a = isqrt(size - 1) + 1
        return a, -(-size // a)

    def encrypt(self, kind: str, size: int, x: int) -> int:
        a, b = self._shape(size)
        tweak = b"%s|%d|" % (kind.encode(), size)
        while True:
            left, right = divmod(x, b)
            for r in range(0, self.rounds, 2):
                left = (left + self._round(tweak, r, right, a)) % a
                right = (right + self._round(tweak, r + 1, left, b)) % b
            x = left * b + right
            if x < size:
                return x

    def decrypt(self, kind: str, size: int, x: int) -> int:
        a, b = self._shape(size)
        tweak = b"%s|%d|" % (kind.encode(), size)
        while True:
            left, right = divmod(x, b)
            for r in range(self.rounds - 2, -1, -2):
                right = (right - self._round(tweak, r + 1, left, b)) % b
                left = (left - self._round(tweak, r, right, a)) % a
            x = left * b + right
            if x < size:
                return x

    def step(self, kind: str, size: int, x: int, by: int = 1) -> int:
        """The pseudonym of x (by = 1) or the value of a pseudonym (by = -1)."""
        return self.decrypt(kind, size, (self.encrypt(kind, size, x) + by) % size)


def luhn_digit(digits: str) -> str:
    """The check digit that completes ``digits``."""
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _fill(shape: str, digits: str) -> str:
    """The digits in the places of the digits of ``shape``."""
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _digits(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def is_card(d: str) -> bool:
    return 13 <= len(d) <= 19 and luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1


def card(value: str, f: Feistel, by: int) -> str | None:
    d = _digits(value)
    if not is_card(d):
        return None
    while True:  # past the one name of equal digits, which is no card
        body = f"{f.step('card', 10 ** (len(d) - 1), int(d[:-1]), by):0{len(d) - 1}d}"
        d = body + luhn_digit(body)
        if is_card(d):
            return _fill(value, d)


def card_spans(run: str) -> list[tuple[int, int]]:
    """Where cards may stand in a run of digit groups, in the order to try; only the groups' lengths decide.

    First the layouts of cards, from any group on. Then the run is cut into pieces of at most 19 digits, and
    each piece is tried whole and by its shorter ends.
    """
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    sizes = [e - s for s, e in groups]
    spans = []
    for i, size in enumerate(sizes):
        if 13 <= size <= 19:
            spans.append(groups[i])
        for layout in LAYOUTS:
            if tuple(sizes[i : i + len(layout)]) == layout:
                spans.append((groups[i][0], groups[i + len(layout) - 1][1]))
    i = 0
    while i < len(sizes):
        total, j, ends = sizes[i], i + 1, []
        while j < len(sizes) and total + sizes[j] <= 19:
            if total >= 13:
                ends.append(j)
            total += sizes[j]
            j += 1
        if 13 <= total <= 19:
            ends.append(j)
        spans += [(groups[i][0], groups[k - 1][1]) for k in reversed(ends)]
        i = j if ends else i + 1
    return list(dict.fromkeys(spans))


def cards_among(run: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The spans with a right check digit, earlier ones winning overlaps; and the refused ones that no earlier one met."""
    taken = bytearray(len(run))
    got, refused = [], []
    for s, e in spans:
        if any(taken[s:e]):
            continue
        if is_card(_digits(run[s:e])):
            taken[s:e] = b"\x01" * (e - s)
            got.append((s, e))
        else:
            refused.append((s, e))
    return got, refused


def phone(value: str, f: Feistel, by: int) -> str | None:
    """A country code after ``+`` and before a separator stays."""
    code = re.match(r"\+\d{1,3}(?=\D)[ .-]?", value)
    head, rest = (code[0], value[len(code[0]) :]) if code else ("", value)
    d = _digits(rest)
    if not 7 <= len(d) <= 15:
        return None
    return head + _fill(rest, f"{f.step('phone', 10 ** len(d), int(d), by):0{len(d)}d}")


def address(value: str, f: Feistel, by: int) -> str | None:
    parts = [int(p) for p in value.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
        return None
    x = f.step("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"), by)
    return ".".join(map(str, x.to_bytes(4, "big")))


def social(value: str, f: Feistel, by: int) -> str | None:
    """Valid numbers have an area of 001-899 but 666, a group of 01-99 and a serial of 0001-9999."""
    a, g, s = map(int, value.split("-"))
    if a in (0, 666) or a > 899 or not g or not s:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    x, s = divmod(f.step("social", 898 * 99 * 9999, x, by), 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def date(value: str, f: Feistel, by: int) -> str | None:
    """Year first, or day and month in the order that is a date (day first where both are)."""
    mark = value[4] if value[4] in "-/." else value[2]
    parts = value.split(mark)
    for order in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        kind = "date" + "".join(map(str, order))
        size, x = LAST_DAY - FIRST_DAY + 1, day - FIRST_DAY
        while True:  # month-first values only take names that can't be read day first, so that they can be undone
            x = f.step(kind, size, x, by)
            new = datetime.date.fromordinal(FIRST_DAY + x)
            if order != (2, 0, 1) or new.day > 12:
                break
        out = [""] * 3
        for i, text in zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")):
            out[i] = text
        return mark.join(out)
    return None


#: Letters that are permuted among themselves; all other characters of a name stay.
_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_ALPHABET_OF = {c: alphabet for alphabet in _ALPHABETS for c in alphabet}


def email(value: str, f: Feistel, by: int) -> str | None:
    """The name before the @ is permuted character class by class; the domain stays."""
    name, _, host = value.rpartition("@")
    size, x, classes = 1, 0, []
    for c in name:
        alphabet = _ALPHABET_OF.get(c)
        classes.append(alphabet)
        if alphabet:
            size, x = size * len(alphabet), x * len(alphabet) + alphabet.index(c)
    if size == 1:
        return None
    x = f.step("email" + "".join(str(_ALPHABETS.index(a)) if a else "-" for a in classes), size, x, by)
    out = []
    for c, alphabet in zip(reversed(name), reversed(classes)):
        if alphabet:
            x, k = divmod(x, len(alphabet))
            c = alphabet[k]
        out.append(c)
    return "".join(reversed(out)) + "@" + host


RULES: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("email", EMAIL, email),
    ("card", CARD, card),
    ("phone", PHONE, phone),
    ("social", SOCIAL, social),
    ("ipv4", IPV4, address),
    ("date", DATE, date),
)


def _meets(found: list[tuple[int, int, str, str]], start: int, end: int) -> bool:
    return any(s < end and start < e for s, e, _, _ in found)


class _Run:
    """A run of digit groups and the values in it.

    A new value must leave the run's cards where they are, or they could not be undone: it takes further steps
    until that is so. Values are undone in reverse order, so that each finds what it was named beside.
    """

    def __init__(self, at: int, text: str, spans: list[tuple[int, int]]):
        self.at, self.text = at, text
        self.cards, refused = cards_among(text, spans)
        self.refused = sorted(refused)
        self.jobs: list[tuple[int, int, int, Callable]] = []

    def renamed(self, text: str, f: Feistel, by: int):
        """``(job, new value)`` of each value."""
        now = list(self.text)
        for k, s, e, rename in self.jobs if by == 1 else reversed(self.jobs):
            value = text[self.at + s : self.at + e]
            lo, hi = max(0, s), min(e, len(now))
            first = bisect.bisect_left(self.refused, (lo - 37,))  # 19 digits and 18 separators are the longest span
            near = [x for x in self.refused[first : bisect.bisect_left(self.refused, (hi,))] if x[1] > lo]
            while True:
                value = rename(value, f, by)
                now[lo:hi] = value[lo - s : hi - s]
                if not any(is_card(_digits("".join(now[x:y]))) for x, y in near):
                    break
            yield k, value


def pseudonymise_text(text: str, f: Feistel, by: int = 1) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and ``(kind, start, end)`` in code points of the original; earlier rules win overlaps."""
    if not HINT.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    runs: list[_Run] = []
    for kind, pattern, rename in RULES:
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "card":
                beside = [x for x in found if x[2] != "card" and x[0] < m.end() and m.start() < x[1]]
                run = _Run(m.start(), m[0], [(s, e) for s, e in card_spans(m[0]) if not _meets(beside, m.start() + s, m.start() + e)])
                runs.append(run)
                for s, e in run.cards:
                    run.jobs.append((len(found), s, e, card))
                    found.append((m.start() + s, m.start() + e, kind, m[0][s:e]))
                continue
            if _meets(found, m.start(), m.end()):
                continue
            new = rename(m[0], f, by)
            if new is None:
                continue
            k = bisect.bisect_left(runs, m.end(), key=lambda r: r.at) - 1  # runs are disjoint, and no match meets two
            if k >= 0 and m.start() < runs[k].at + len(runs[k].text):
                run = runs[k]
                run.jobs.append((len(found), m.start() - run.at, m.end() - run.at, rename))
            found.append((m.start(), m.end(), kind, new))
    for run in runs:
        for k, new in run.renamed(text, f, by):
            found[k] = (*found[k][:3], new)
    found.sort()
    out, at = [], 0
    for s, e, _, new in found:
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), [(kind, s, e) for s, e, kind, _ in found]


_made_keys: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING. Without it the application makes a secret one, once, that nobody learns: values stay
    linked within the application, and can't be undone."""
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key.encode()
    return _made_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", undo: bool = False) -> DataFrame:
    """``(doc_id, text, n_replaced, spans)``, one row for each input row; ``undo`` gives the originals back.

    A null text stays null, without spans. Null ids and repeated rows stay. An empty table gives an empty
    result; other columns are ignored (``pseudonymise_rows`` keeps them). ``spans`` is ``kind:start:end``,
    joined by commas.
    """
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return pseudonymise_rows(rows, key, "text", undo, count_col="n_replaced", spans_col="spans")


def pseudonymise_rows(
    rows: DataFrame, key: bytes, text_col: str = "text", undo: bool = False,
    count_col: str | None = None, spans_col: str | None = None,
) -> DataFrame:
    """All columns of ``rows`` with the text replaced in place; the number of values and their spans where columns for
    them are named, which must be new. Each row is handled by itself: nulls, repeats and other columns pass through."""
    import pyarrow as pa

    if not key:
        raise ValueError("a secret key is needed")
    added = [c for c in (count_col, spans_col) if c]
    if taken := {c.lower() for c in added} & {c.lower() for c in rows.columns}:
        raise ValueError(f"the input has columns of these names: {sorted(taken)}")
    at = rows.columns.index(text_col)
    names = [*rows.columns, *added]
    # names by place: mapInArrow resolves the names of its input, and a name may hold a dot
    rows = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
    rows = rows.withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    kinds = [t for c, t in ((count_col, "int"), (spans_col, "string")) if c]
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), *(f"a{k} {t}" for k, t in enumerate(kinds))])

    def run(batches):
        f = Feistel(key)
        for b in slices(batches):
            texts, counts, spans = [], [], []
            for text in b.column(at).to_pylist():
                new, found = (None, []) if text is None else pseudonymise_text(text, f, -1 if undo else 1)
                texts.append(new)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{s}:{e}" for k, s, e in found) if spans_col else None)
            columns = list(b.columns)
            columns[at] = pa.array(texts, pa.string())
            more = ((count_col, pa.array(counts, pa.int32())), (spans_col, pa.array(spans, pa.string())))
            columns += [v for c, v in more if c]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *(f"a{k}" for k in range(len(kinds)))])

    return rows.mapInArrow(run, schema).toDF(*names)


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), session_key(spark))
