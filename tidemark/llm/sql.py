"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm import collocations, fim, lm, quality, substring

_IS_WORD = "[^ \\t\\n\\v\\f\\r]"


def _bounds() -> str:
    sides = [f"coalesce({name} {op} {value}, true)" for name, *limits in quality.THRESHOLDS
             for op, value in zip((">=", "<="), limits, strict=True) if value is not None]
    return " AND ".join(sides)


def _char_count(chars: str) -> str:
    return f"length(t) - length(translate(t, '{chars}', ''))"


_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS))) + "]"
_WIDTH = quality.REPEAT_WINDOW

QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_IS_WORD}+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_IS_WORD}')) AS lines FROM d),
places AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - {_WIDTH - 1})) AS i FROM w WHERE len(words) >= {_WIDTH}),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i : i + {_WIDTH - 1}]) AS times FROM places),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM
             (SELECT doc_id, unnest(generate_series(i, i + {_WIDTH - 1})) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
             {_char_count(quality.SYMBOLS)} AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda x: list_contains({_STOP}, lower(x)))) AS n_stop,
             len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_shout, {_char_count("0123456789")} AS n_digits
      FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
r AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(word_chars, 0) AS symbol_ratio,
             n_shout / nullif(n_words, 0) AS shout_ratio, (n_stop + 1) / nullif(n_words, 0) AS stop_ratio,
             n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_digits / nullif(word_chars, 0) AS digit_ratio,
             n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, cast(n_words AS bigint) AS n_words, cast(word_chars AS bigint) AS word_chars, cast(n_symbols AS bigint) AS n_symbols,
       cast(n_dup_lines AS bigint) AS n_dup_lines, cast(n_repeat_words AS bigint) AS n_repeat_words, base_failed,
       NOT base_failed AND {_bounds()} AS kept
FROM r
"""

_LAST = substring.WINDOW - 1

SUBSTRING_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_IS_WORD}+') AS words FROM documents),
p AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(words) - {_LAST}), lambda i: array_to_string(words[i : i + {_LAST}], ' '))) AS win,
             unnest(generate_series(1, len(words) - {_LAST})) AS i FROM w WHERE len(words) > {_LAST}),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM p),
g AS (SELECT doc_id, list(k) AS gone FROM
       (SELECT DISTINCT doc_id, unnest(generate_series(i, i + {_LAST})) AS k FROM f WHERE first < doc_id) GROUP BY doc_id)
SELECT w.doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(len(gone), 0) AS bigint) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN words
              ELSE list_filter(words, lambda v, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

LM_ORDER_2_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_IS_WORD}+') AS words FROM documents),
t AS (SELECT doc_id, unnest(words) AS w, unnest(list_prepend(NULL, words[: len(words) - 1])) AS u FROM d WHERE len(words) > 0),
one AS (SELECT w, count(*) AS n FROM t GROUP BY w),
own AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
two AS (SELECT u, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY ALL),
own2 AS (SELECT doc_id, u, w, count(*) AS n FROM t WHERE u IS NOT NULL GROUP BY ALL),
c AS (SELECT t.doc_id, t.u, one.n - own.n AS n1, two.n - own2.n AS n2, cone.n - cown.n AS nu, (SELECT count(*) FROM t) - len(d.words) AS rest
      FROM t JOIN d ON t.doc_id = d.doc_id JOIN one ON one.w = t.w JOIN own ON own.doc_id = t.doc_id AND own.w = t.w
      LEFT JOIN two ON two.u = t.u AND two.w = t.w LEFT JOIN own2 ON own2.doc_id = t.doc_id AND own2.u = t.u AND own2.w = t.w
      LEFT JOIN one cone ON cone.w = t.u LEFT JOIN own cown ON cown.doc_id = t.doc_id AND cown.w = t.u),
s AS (SELECT doc_id, coalesce(n2, 0) <= 0 AND n1 <= 0 AS unseen, u IS NOT NULL AND n2 <= 0 AS backed,
             CASE WHEN n2 > 0 THEN ln(n2 / nu)
                  ELSE CASE WHEN u IS NOT NULL THEN ln({lm.BACKOFF}) ELSE 0 END
                     + CASE WHEN n1 > 0 THEN ln(n1 / rest) ELSE -ln(rest + 1) END END AS x FROM c),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (unseen) AS n_unseen, count(*) FILTER (backed) AS n_backoffs, sum(x) AS total FROM s GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.words) AS bigint) AS n_words, coalesce(n_unseen, 0) AS n_unseen, coalesce(n_backoffs, 0) AS n_backoffs,
       round(coalesce(total, 0), 6) AS log_score, round(total / n, 6) AS mean_log_score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

LM_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_IS_WORD}+') AS words FROM documents),
i AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM d WHERE len(words) > 0),
t AS (SELECT doc_id, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS u, CASE WHEN i > 2 THEN words[i - 2] END AS v,
             (SELECT count(*) FROM i) - len(words) AS rest FROM i),
c AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS n1,
             count(*) OVER (PARTITION BY u, w) - count(*) OVER (PARTITION BY doc_id, u, w) AS n2,
             count(*) OVER (PARTITION BY v, u, w) - count(*) OVER (PARTITION BY doc_id, v, u, w) AS n3 FROM t),
b AS (SELECT *, lag(n1) OVER p AS nu, lag(n2) OVER p AS nvu, v IS NOT NULL AND n3 > 0 AS three, u IS NOT NULL AND n2 > 0 AS two
      FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, n1 <= 0 AS unseen,
             CASE WHEN three THEN 0 ELSE cast(v IS NOT NULL AS int) + CASE WHEN two THEN 0 ELSE cast(u IS NOT NULL AS int) END END AS backed,
             CASE WHEN three THEN ln(n3 / nvu) WHEN two THEN ln(n2 / nu) WHEN n1 > 0 THEN ln(n1 / rest) ELSE -ln(rest + 1) END AS x FROM b),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (unseen) AS n_unseen, cast(sum(backed) AS bigint) AS n_backoffs,
             sum(x + backed * ln({lm.BACKOFF})) AS total FROM s GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.words) AS bigint) AS n_words, coalesce(n_unseen, 0) AS n_unseen, coalesce(n_backoffs, 0) AS n_backoffs,
       round(coalesce(total, 0), 6) AS log_score, round(total / n, 6) AS mean_log_score
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

_UNIT = "[ \\t\\n\\v\\f\\r]*[^ \\t\\n\\v\\f\\r]+|[ \\t\\n\\v\\f\\r]+"


def _part(a: str, b: str) -> str:
    return f"array_to_string(units[{a} + 1 : {b}], '')"


FIM_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS units,
                  sha256('{fim.SEED}:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, units, len(units) AS n, ('0x' || x[1:8])::ubigint AS h1, ('0x' || x[9:16])::ubigint AS h2,
             ('0x' || x[17:24])::ubigint AS h3, ('0x' || x[25:32])::ubigint AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN t = '' OR doc_id IS NULL OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {fim.RATE} THEN 'plain'
                  WHEN h4 % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, {_part("0", "a")} AS p, {_part("a", "b")} AS m, {_part("b", "n")} AS s FROM c)
SELECT doc_id, cast(n AS bigint) AS n, form,
       CASE WHEN form <> 'plain' THEN cast(length(p) AS bigint) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN cast(length(m) AS bigint) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COLLOCATION_SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\n\\v\\f\\r]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS words FROM p),
g AS (SELECT lang, size, unnest(list_transform(generate_series(1, len(words) - size + 1), lambda i: array_to_string(words[i : i + size - 1], ' '))) AS phrase
      FROM w, generate_series(1, {collocations.SPAN}) AS s(size) WHERE len(words) >= size),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
total AS (SELECT lang, cast(sum(a) AS bigint) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS words FROM f WHERE size > 1 AND a >= {collocations.MIN_COUNT}),
k AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c),
cut AS (SELECT k.*, x.a AS l, y.a AS r, cast({collocations.SCORE} AS hugeint) * k.a // (x.a + y.a) AS score FROM k
        JOIN f AS x ON x.lang = k.lang AND x.phrase = array_to_string(k.words[: k.k], ' ')
        JOIN f AS y ON y.lang = k.lang AND y.phrase = array_to_string(k.words[k.k + 1 :], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, words, size, unnest(generate_series(2, size - 1)) AS n FROM c WHERE size > 2),
inside AS (SELECT lang, a, unnest(list_transform(generate_series(1, size - n + 1), lambda i: array_to_string(words[i : i + n - 1], ' '))) AS phrase FROM inner_),
longer AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase,
       a, l, r, n, cast(score AS bigint) AS score
FROM best JOIN total ON total.lang = best.lang LEFT JOIN longer ON longer.lang = best.lang AND longer.phrase = best.phrase
WHERE longer IS NULL OR cast(100 AS hugeint) * longer < cast({collocations.SHADOW_PERCENT} AS hugeint) * a
QUALIFY rank <= {collocations.MOST}
"""
