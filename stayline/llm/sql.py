"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quotes import ATTRIBUTION, MARKS
from .secrets import BASE_RULES, RULES


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def secret_spans() -> str:
    """Every rule's matches with the text before each (``gap``); places are running sums of both lengths."""
    finds = " UNION ALL ".join(
        f"SELECT text, {k} AS kind_no, '{r.kind}' AS kind, unnest(m) AS match, unnest(gaps[1:len(m)]) AS gap,"
        f" generate_subscripts(m, 1) AS i, {_quoted(r.check)} AS ok"
        f" FROM (SELECT text, regexp_extract_all(text, {_quoted(r.pattern)}) AS m,"
        f" string_split_regex(text, {_quoted(r.pattern)}) AS gaps FROM blobs)"
        for k, r in enumerate(RULES)
    )
    base = len(BASE_RULES)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)
    sums = ", ".join(f"sum((kind_no = {k})::INT)::BIGINT AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  blobs AS (SELECT DISTINCT text FROM docs),
  finds AS ({finds}),
  placed AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY text, kind_no ORDER BY i) AS stop FROM finds),
  spans AS (
    SELECT text, kind_no, stop - length(match) AS start, kind || ':' || (stop - length(match)) || ':' || stop AS span
    FROM placed WHERE regexp_matches(match, ok)),
  found AS (
    SELECT text, {sums}, string_agg(span, ',' ORDER BY start, kind_no) AS spans,
      string_agg(span, ',' ORDER BY start, kind_no) FILTER (kind_no < {base}) AS base_spans
    FROM spans GROUP BY text)
SELECT doc_id, {counts}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob
FROM docs LEFT JOIN found USING (text)"""


def quote_links() -> str:
    marks, attribution = _quoted(MARKS), _quoted(ATTRIBUTION)
    norm = r"trim(regexp_replace(lower(body), '[^\p{L}\p{N}]+', ' ', 'g'))"
    return rf"""
WITH RECURSIVE messages AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY 1, 2, 3, 4),
  split AS (
    SELECT conv_id, turn, role, text, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM messages),
  marked AS (SELECT *, regexp_extract(line, {marks}) AS marks FROM split WHERE NOT regexp_matches(line, {attribution})),
  lines AS (
    SELECT conv_id, turn, role, text, line_no, length(marks) - length(replace(marks, '>', '')) AS level,
      line[length(marks) + 1:] AS body FROM marked),
  turns AS (
    SELECT *, coalesce((lag(level) OVER (PARTITION BY conv_id, turn, role, text ORDER BY line_no) <> level)::INT, 1) AS new
    FROM lines),
  runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, turn, role, text ORDER BY line_no) AS run FROM turns),
  bodies AS (
    SELECT conv_id, turn, role, text, level, string_agg(body, chr(10) ORDER BY line_no) AS body
    FROM runs GROUP BY conv_id, turn, role, text, level, run
    UNION ALL SELECT conv_id, turn, role, text, level, body FROM lines),
  units AS (SELECT DISTINCT conv_id, turn, role, text, level, {norm} AS passage FROM bodies WHERE {norm} <> ''),
  origins AS (SELECT conv_id, passage, min(turn) AS origin FROM units WHERE level = 0 GROUP BY ALL),
  quotes AS (
    SELECT u.conv_id, u.turn, u.role, u.text, level, len(string_split(u.passage, ' ')) AS words, CASE WHEN origin < u.turn THEN origin END AS origin
    FROM units u LEFT JOIN origins o ON u.conv_id = o.conv_id AND u.passage = o.passage WHERE level > 0),
  by_origin AS (
    SELECT conv_id, turn, role, text, origin, level, sum(words) AS words, count(*) AS n FROM quotes GROUP BY ALL),
  ranked AS (
    SELECT *, row_number() OVER (
      PARTITION BY conv_id, turn, role, text ORDER BY origin IS NULL, level, words DESC, origin DESC) AS place
    FROM by_origin),
  links AS (
    SELECT conv_id, turn, role, text, max(origin) FILTER (place = 1) AS reply_to, sum(n)::BIGINT AS n_passages,
      coalesce(sum(n) FILTER (origin IS NOT NULL), 0)::BIGINT AS n_linked, max(level)::BIGINT AS max_level
    FROM ranked GROUP BY ALL),
  parents AS (SELECT conv_id, turn, min(reply_to) AS parent FROM links WHERE reply_to IS NOT NULL GROUP BY ALL),
  chains AS (
    SELECT conv_id, turn, parent AS root FROM parents
    UNION ALL
    SELECT c.conv_id, c.turn, p.parent FROM chains c JOIN parents p ON p.conv_id = c.conv_id AND p.turn = c.root),
  roots AS (SELECT conv_id, turn, min(root) AS root FROM chains GROUP BY ALL),
  placed AS (
    SELECT m.*, l.reply_to, coalesce(r.root, l.reply_to, m.turn) AS root, n_passages, n_linked, max_level
    FROM messages m LEFT JOIN links l
      ON m.conv_id = l.conv_id AND m.turn = l.turn AND m.role IS NOT DISTINCT FROM l.role AND m.text = l.text
    LEFT JOIN roots r ON r.conv_id = m.conv_id AND r.turn = l.reply_to)
SELECT conv_id, turn, role, reply_to, root,
  row_number() OVER (
    PARTITION BY conv_id
    ORDER BY root NULLS FIRST, turn NULLS FIRST, coalesce(role, ''), role NULLS FIRST, text) - 1 AS position,
  coalesce(n_passages, 0) AS n_passages, coalesce(n_linked, 0) AS n_linked, coalesce(max_level, 0) AS max_level,
  regexp_replace(
    array_to_string([x FOR x IN string_split(text, chr(10)) IF regexp_extract(x, {marks}) = '' AND NOT regexp_matches(x, {attribution})], chr(10)),
    '^\s+|\s+$', '', 'g') AS text,
  copies
FROM placed"""


EXACT_DUPLICATES = r"""
WITH docs AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents),
  ranked AS (
    SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
      first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
      row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS place
    FROM docs)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked"""

ORACLE_SQL: dict[str, str] = {
    "op6_secret_ledger": secret_spans(),
    "op9_quote_linking": quote_links(),
    "op10_exact_dedup": EXACT_DUPLICATES,
}


def vector_codes() -> str:
    """Four rounds of exact codebooks; products of integers this small are exact in doubles."""

    def assigned(k: int) -> str:
        far = "list_dot_product(b.c, b.c) - 2 * list_dot_product(p.x, b.c)"
        return (
            f"a{k} AS MATERIALIZED (SELECT p.r, p.part, p.x, min_by(b.entry, ({far}) * 256 + b.entry) AS entry,"
            f" min({far}) + list_dot_product(p.x, p.x) AS d FROM pieces p JOIN b{k} b USING (part) GROUP BY p.r, p.part, p.x)"
        )

    rounds = ""
    for k in range(4):
        rounds += f""",
  {assigned(k)},
  m{k} AS (
    SELECT part, entry, list(floor(s / n) ORDER BY i) AS c FROM (
      SELECT part, entry, i, sum(x) AS s, count(*) AS n
      FROM (SELECT part, entry, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY ALL),
  b{k + 1} AS MATERIALIZED (
    SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))"""
    return f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, v FROM (
      SELECT vec_id, label, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
  pieces AS MATERIALIZED (
    SELECT r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS part)),
  b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM pieces WHERE r <= 256){rounds},
  {assigned(4)},
  coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY r),
  digest AS (
    SELECT sha256(string_agg(c::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(c) AS c, generate_subscripts(c, 1) AS i FROM b4))
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest"""


ORACLE_SQL["op11_vector_codes"] = vector_codes()


COLLOCATIONS = r"""
WITH docs AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
  pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
  lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM lists),
  found AS (SELECT lang, w[i : i + m - 1] AS words FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
  grams AS MATERIALIZED (SELECT lang, words, len(words) AS m, count(*) AS f FROM found GROUP BY ALL HAVING count(*) >= 100),
  totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY lang),
  cuts AS (SELECT lang, words, m, f AS a, unnest(range(1, m)) AS k FROM grams WHERE m > 1),
  scored AS (
    SELECT c.lang, c.words, a, k, x.f AS l, y.f AS r, n,
      ((1000::HUGEINT * a * n::HUGEINT) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c JOIN grams x ON x.lang = c.lang AND x.words = c.words[1 : k]
    JOIN grams y ON y.lang = c.lang AND y.words = c.words[k + 1 : c.m] JOIN totals t ON t.lang = c.lang),
  weakest AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM scored),
  spans AS (SELECT lang, words, m, f, unnest(range(2, m)) AS s FROM grams WHERE m > 2),
  places AS (SELECT *, unnest(range(1, m - s + 2)) AS i FROM spans),
  inside AS (SELECT lang, words[i : i + s - 1] AS words, max(f) AS longer FROM places GROUP BY ALL),
  rest AS (
    SELECT w.lang, array_to_string(w.words, ' ') AS phrase, a, l, r, n, score
    FROM weakest w LEFT JOIN inside i ON i.lang = w.lang AND i.words = w.words
    WHERE place = 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM rest)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked WHERE rank <= 2000"""

ORACLE_SQL["op13_collocations"] = COLLOCATIONS
