"""The rules of ``rules.judge`` over ``documents`` and ``labels`` in DuckDB."""

from __future__ import annotations

from . import rules

_RULES = {
    "symbols": "n_symbols * {s} // greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines * {s} // greatest(n_lines, 1)",
    "repeats": "n_repeat_words * {s} // greatest(n_words, 1)",
    "upper": "n_upper * {s} // greatest(word_chars, 1)",
    "bangs": "n_bangs * {s} // greatest(n_words, 1)",
    "same_words": "(n_words - n_distinct) * {s} // greatest(n_words, 1)",
}
_STEPS = " UNION ALL ".join(f"SELECT rid, doc_id, stratum, base_failed, '{r}' AS rule, least({rules.STEPS}, {m.format(s=rules.STEPS)}) AS step FROM c" for r, m in _RULES.items())

SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
v AS (
  SELECT rid, i, array_to_string(words[i : i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM v) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid),
b AS (
  SELECT d.rid, doc_id, stratum, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-ZÀ-Þ]', '', 'g')) AS n_upper,
         length(t) - length(replace(t, '!', '')) AS n_bangs, len(list_distinct(words)) AS n_distinct, len(lines) AS n_lines
  FROM d LEFT JOIN covered ON covered.rid = d.rid),
c AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
s AS ({_STEPS}),
good AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
p AS (SELECT CAST({rules.ALPHA!r} AS DOUBLE) / {len(_RULES)} AS own, CAST({rules.DELTA!r} AS DOUBLE) / {len(_RULES)} AS level),
sizes AS (
  SELECT stratum, n, own, level / count(*) OVER () AS level
  FROM (SELECT stratum, count(*) // {len(_RULES)} AS n FROM good GROUP BY stratum), p WHERE n >= CAST(trunc(ln(level) / ln(1 - own)) AS BIGINT)),
h AS (SELECT stratum, rule, step, count(*) AS n FROM good GROUP BY stratum, rule, step),
r AS (
  SELECT z.stratum, u.rule, k.step, z.n, z.own, z.level, CAST(sum(coalesce(h.n, 0)) OVER (PARTITION BY z.stratum, u.rule ORDER BY k.step DESC) AS BIGINT) AS k
  FROM sizes z CROSS JOIN (SELECT DISTINCT rule FROM s) u CROSS JOIN range(1, {rules.STEPS + 1}) k(step)
  LEFT JOIN h ON h.stratum = z.stratum AND h.rule = u.rule AND h.step = k.step),
proved AS (
  SELECT *, k < n AND list_sum(list_transform(range(0, least(k, n - 1) + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(own) + (n - i) * ln(1 - own)))) <= level AS ok FROM r),
cuts AS (SELECT stratum, rule, min(step) AS cut FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY step DESC) AS so_far FROM proved) WHERE so_far GROUP BY stratum, rule),
hit AS (SELECT DISTINCT rid FROM s JOIN cuts ON cuts.stratum = s.stratum AND cuts.rule = s.rule WHERE s.step >= cuts.cut)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM hit) AS kept
FROM c
"""
