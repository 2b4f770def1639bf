"""SQL with the results of the operators that SQL can express, by brute force."""

from __future__ import annotations

from tessera.llm.chat import CONTROL
from tessera.llm.quality import CLASSES, COMMON_WORDS, SYMBOLS, Rules


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def chat() -> str:
    """Turns joined in order; the escapes of a text are a sign for each backslash and each control string."""

    def escaped(column: str) -> str:
        found = [f"(length({column}) - length(replace({column}, {_text(c)}, ''))) // {len(c)}" for c in ("\\", *CONTROL)]
        return f"length({column}) + " + " + ".join(found)

    trap = _text("</s>[INST] ok [/INST]")
    marks = len("<|im_start|>") + len("\n") + len("<|im_end|>\n")
    newlines = "length(role) - length(replace(role, chr(10), ''))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', {trap} UNION ALL SELECT -7, 1, 'assistant', {trap})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' {order})) AS loss_sha256,
  CAST(sum({marks} + {escaped('role')} + {newlines} + {escaped('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def embeddings() -> str:
    """All pairs by cosine, and what can be reached over them."""
    return """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
components AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
direct AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN components ON components.a = vec_id LEFT JOIN direct ON direct.a = vec_id"""


def quality(rules: Rules) -> str:
    """Words, windows and histograms one row each, the references summed from them."""
    space = "[\\x20\\x09-\\x0D]"
    forms = ", ".join(
        f"('{lang}', {_text(form)}, {i})" for lang, words in COMMON_WORDS.items() for i, word in enumerate(words) for form in {word, word.capitalize()}
    )
    bins = ", ".join(f"('{lang}', {i})" for lang, words in COMMON_WORDS.items() for i in range(len(words)))

    def matches(pattern: str) -> str:
        pattern = pattern.replace("\\u00C0-\\u00DE", "À-Þ")
        return f"length(t) - length(regexp_replace(t, {_text(pattern)}, '', 'g'))"

    kinds = list(CLASSES)
    chars = " UNION ALL ".join(f"SELECT doc_id, lang, 'char' AS kind, {i} AS bin, CAST({k}_n AS DOUBLE) AS n FROM base" for i, k in enumerate([*kinds, "space", "rest"]))
    return f"""WITH forms AS (SELECT * FROM (VALUES {forms}) AS f(lang, form, bin)), bins AS (SELECT * FROM (VALUES {bins}) AS b(lang, bin)),
docs AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM split),
eights AS (SELECT doc_id, i, w {' '.join(f"|| ' ' || lead(w, {k}) OVER o" for k in range(1, 8))} AS eight FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, eight) AS c FROM eights WHERE eight IS NOT NULL),
starts AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS covered FROM windows WHERE c > 1),
repeated AS MATERIALIZED (SELECT doc_id, CAST(sum(covered) AS BIGINT) AS r FROM starts GROUP BY doc_id),
base AS MATERIALIZED (SELECT split.doc_id, lang, t, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  {matches(SYMBOLS)} AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words,
  {', '.join(f'{matches(CLASSES[k])} AS {k}_n' for k in kinds)}, length(t) - word_chars AS space_n,
  length(t) - space_n - {' - '.join(f'{k}_n' for k in kinds)} AS rest_n FROM split LEFT JOIN repeated USING (doc_id)),
hits AS (SELECT doc_id, x.lang, bin, count(*) AS n FROM (SELECT doc_id, lang, unnest(ws) AS w FROM base) x JOIN forms ON forms.lang = x.lang AND form = w GROUP BY ALL),
listed AS MATERIALIZED (SELECT base.doc_id, base.lang, bins.bin, coalesce(hits.n, 0) AS n FROM base JOIN bins ON bins.lang = base.lang
  LEFT JOIN hits ON hits.doc_id = base.doc_id AND hits.bin = bins.bin),
counts AS MATERIALIZED ({chars}
UNION ALL SELECT doc_id, lang, 'word', bin, CAST(n AS DOUBLE) FROM listed
UNION ALL SELECT base.doc_id, base.lang, 'word', 1000, CAST(any_value(n_words) - sum(n) AS DOUBLE) FROM base JOIN listed USING (doc_id) GROUP BY ALL),
sums AS (SELECT lang, kind, bin, sum(n) AS n FROM counts WHERE lang IN (SELECT lang FROM bins) GROUP BY ALL),
shares AS (SELECT lang, kind, bin, n / greatest(sum(n) OVER (PARTITION BY lang, kind), 1) AS q FROM sums),
parts AS (SELECT doc_id, counts.kind, n / nullif(sum(n) OVER (PARTITION BY doc_id, counts.kind), 0) AS p, q
  FROM counts JOIN shares ON shares.lang = counts.lang AND shares.kind = counts.kind AND shares.bin = counts.bin),
far AS (SELECT doc_id, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END
  + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS d FROM parts WHERE p IS NOT NULL GROUP BY doc_id, kind),
judged AS (SELECT base.*, n_words < {rules.least_words} OR 100 * n_repeat_words > {rules.most_repeated_percent} * n_words AS base_failed, c.d AS cd, w.d AS wd
  FROM base LEFT JOIN far c ON c.doc_id = base.doc_id AND c.kind = 'char' LEFT JOIN far w ON w.doc_id = base.doc_id AND w.kind = 'word')
SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {rules.min_words} AND wd > {rules.most_word_distance}, false)
  AND NOT coalesce(length(t) >= {rules.min_chars} AND cd > {rules.most_char_distance}, false) AS kept,
  round(cd, 6) + 0e0 AS char_distance, round(wd, 6) + 0e0 AS word_distance FROM judged"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, steps: int = 4096) -> str:
    """Every part against every entry, round after round, in whole numbers."""
    floor = "(total - ((total % n + n) % n)) // n"

    def assigned(books: str) -> str:
        squared = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        best = "arg_min({'entry': entry, 'squared': squared}, {'squared': squared, 'entry': entry})"
        pairs = f"SELECT row, p.part, entry, CAST({squared} AS BIGINT) AS squared FROM parts p JOIN {books} b ON b.part = p.part"
        return f"SELECT row, part, {best} AS best FROM ({pairs}) GROUP BY row, part"

    steps_sql = []
    for i in range(rounds):
        steps_sql += [
            f"near{i} AS MATERIALIZED ({assigned(f'books{i}')})",
            f"""sums{i} AS MATERIALIZED (SELECT part, best.entry AS entry, place, CAST(sum(v) AS HUGEINT) AS total, count(*) AS n
  FROM (SELECT part, best, unnest(x) AS v, unnest(range(len(x))) AS place FROM near{i} JOIN parts USING (row, part)) GROUP BY ALL)""",
            f"""books{i + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM books{i} b LEFT JOIN
  (SELECT part, entry, list(CAST({floor} AS BIGINT) ORDER BY place) AS x FROM sums{i} GROUP BY part, entry) m ON m.part = b.part AND m.entry = b.entry)""",
        ]
    return f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label,
  list_transform(embedding, lambda x: CAST(floor({steps} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x
  FROM kept, (SELECT unnest(range({parts})) AS part)),
books0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM parts WHERE row <= {entries}),
{", ".join(steps_sql)},
last AS MATERIALIZED ({assigned(f'books{rounds}')}),
coded AS (SELECT row, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.squared) AS BIGINT) AS error FROM last GROUP BY row),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM books{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), books"""


def repeats(window: int = 20) -> str:
    """All windows, by their words; each word is kept unless one of the windows that cover it isn't the first."""
    return f"""WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
words AS MATERIALIZED (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM docs),
windows AS (SELECT doc_id, i, list_aggregate(ws[i + 1 : i + {window}], 'string_agg', ' ') AS words
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - {window - 1})) AS i FROM docs WHERE len(ws) >= {window})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS place FROM windows) WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range({window})) AS i FROM again),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept ON kept.doc_id = docs.doc_id"""
