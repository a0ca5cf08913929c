"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from barloom.llm.license_rules import RULES
from barloom.llm.licenses import BASE, SURE

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256, {LOWERED} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""

QUALITY = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n, count(*) AS lines FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0) AS n_lines
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)),
x AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    [10.0::DOUBLE / greatest(n_words, 1), CASE WHEN n_repeat_words >= n_words THEN 1e6::DOUBLE ELSE n_repeat_words::DOUBLE / (n_words - n_repeat_words) / (0.2::DOUBLE / (1 - 0.2::DOUBLE)) END,
     n_symbols::DOUBLE / nullif(n_words, 0) / 0.1::DOUBLE, n_dup_lines::DOUBLE / nullif(n_lines - n_dup_lines, 0) / (0.3::DOUBLE / (1 - 0.3::DOUBLE))] AS excess FROM m),
b AS (
  SELECT *, [n_words < 10, 100 * n_repeat_words > 20 * n_words, n_symbols > n_words, n_dup_lines > 0.3 * n_words]
    || list_transform(excess, lambda e: coalesce(e > 1, FALSE)) AS broken FROM x),
h AS (
  SELECT source, r, count(*) AS n, sum(broken[r]::INT) AS f FROM b, (SELECT unnest(range(1, 9)) AS r) GROUP BY source, r),
a AS (SELECT r, sum(n) AS docs, count(*) AS hosts, sum(f) / sum(n) AS mu FROM h GROUP BY r),
v AS (SELECT r, any_value(mu) AS mu, sum(n * pow(f / n - mu, 2)) / sum(n) - any_value(mu * (1 - mu) * hosts / docs) AS var FROM h JOIN a USING (r) GROUP BY r),
s AS (SELECT r, mu, least(greatest(mu * (1 - mu) / greatest(var, 1e-12) - 1, 2.0), 1000.0) AS strength FROM v),
rate AS (SELECT source, list((f + strength * mu) / (n + strength) ORDER BY r) AS rates FROM h JOIN s USING (r) GROUP BY source),
odds AS (
  SELECT b.*, rates, list_transform(range(1, 5), lambda r: CASE WHEN excess[r] > 0 THEN ln((rates[r + 4] + 1e-6) / (1 - rates[r + 4] + 1e-6)) + 4.0::DOUBLE * ln(excess[r]) > 0 END) AS junk
  FROM b JOIN rate ON b.source IS NOT DISTINCT FROM rate.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT list_max(rates[1:4]) > 0.5 AND NOT coalesce(list_bool_or(junk), FALSE)
  AND NOT ((broken[1] AND rates[1] > 0.2) OR (broken[2] AND rates[2] > 0.2) OR (broken[3] AND rates[3] > 0.2) OR (broken[4] AND rates[4] > 0.2)) AS kept
FROM odds
"""

CHAT = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g') AS r2,
    regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g') AS t2 FROM r),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(r2) + length(t2) + length('<s>[INST][/INST]</s>'))::BIGINT AS formatted_chars
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""


def _values(rows) -> str:
    def shown(x) -> str:
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join(f"({', '.join(map(shown, row))})" for row in rows)


LICENSES = rf"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
m AS (SELECT *, '<' || array_to_string(ws, '><') || '>' AS t FROM w),
phrases AS (SELECT string_split(phrase, ' ') AS p, label FROM (VALUES {_values(BASE)}) AS v(phrase, label)),
base AS (
  SELECT rid, count(*) AS n, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels
  FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) JOIN phrases ON ws[i] = p[1] AND ws[i:i + len(p) - 1] = p GROUP BY rid),
rules AS (FROM (VALUES {_values(RULES)}) AS v(rule, label, priority, keyword, pattern)),
hit AS (
  SELECT rid, rule, label, priority, string_split_regex(t, pattern) AS gaps, regexp_extract_all(t, pattern) AS inside
  FROM m JOIN rules ON list_contains(ws, keyword)),
one AS (SELECT rid, rule, label, priority, generate_subscripts(inside, 1) AS k, unnest(inside) AS h, unnest(gaps[:len(inside)]) AS g FROM hit WHERE len(inside) > 0),
sized AS (SELECT *, length(h) - length(replace(h, '<', '')) AS size, length(g) - length(replace(g, '<', '')) AS gap FROM one),
placed AS (SELECT *, sum(gap + size) OVER (PARTITION BY rid, rule ORDER BY k) AS e, sum(gap + size) OVER (PARTITION BY rid, rule ORDER BY k) - size AS s FROM sized),
reach AS (
  SELECT *, {", ".join(f"max(CASE WHEN priority >= {p} THEN e END) OVER before AS e{p}" for p in SURE)}
  FROM placed WINDOW before AS (PARTITION BY rid ORDER BY s, e DESC, priority DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
kept AS (
  SELECT rid, list(DISTINCT label) AS labels, max(CASE priority {" ".join(f"WHEN {p} THEN {x}" for p, x in SURE.items())} END) AS sure
  FROM reach WHERE coalesce(CASE priority {" ".join(f"WHEN {p} THEN e{p}" for p in SURE)} END, -1) < e GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(kept.labels, []))), ',') AS labels,
  greatest(coalesce(sure, 0), CASE WHEN n > 0 THEN {SURE[1]} ELSE 0 END)::DOUBLE AS score
FROM m LEFT JOIN base USING (rid) LEFT JOIN kept USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": QUALITY, "op7_chat_format": CHAT, "op10_exact_dedup": EXACT_DEDUP, "op13_licenses": LICENSES}
