"""DuckDB SQL for the operators that SQL can express, written apart from their DataFrame code."""

from __future__ import annotations

from . import quality, substrings, urls

BLANKS = r"[ \x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{BLANKS}'), lambda x: x <> '')"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


def passages() -> str:
    n = substrings.WINDOW
    return f"""
WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + {n - 1}], ' ') AS k FROM w, unnest(range(1, len(ws) - {n - 2})) t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM g) WHERE c > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(0, {n}) t(j)),
word AS (SELECT doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) t(p)),
left_over AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN left_over USING (doc_id)"""


def lines() -> str:
    phrase = " OR ".join(f"contains(lower(line), '{p}')" for p in quality.BOILERPLATE)
    count = lambda pattern: f"len(regexp_extract_all(line, '{pattern}'))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM d, unnest(range(1, len(ws) - 3)) t(i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, range(0, 5) t(j) GROUP BY doc_id),
line AS (SELECT doc_id, line, len({_words("line")}) AS n FROM d, unnest(string_split(text, chr(10))) t(line)),
judged AS (
  SELECT doc_id, line, n, n > 0 AND (
    ({count(quality.MENU)} > 0 AND {count(quality.MENU)} * {quality.MENU_WORDS} >= n) OR {count(quality.SYMBOL)} >= n * {quality.NOISE}
    OR (n < {quality.SHORT_LINE} AND NOT regexp_matches(line, '{_quoted(quality.FINAL_MARK)}')) OR {phrase}) AS fails
  FROM line),
per AS (
  SELECT doc_id, count(line) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines, coalesce(sum(n) FILTER (fails), 0) AS n_removed
  FROM judged GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '{quality.SYMBOL}'))::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, n_removed::BIGINT AS n_removed
  FROM d JOIN per USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_removed <= n_words * {quality.MOST_REMOVED} AS kept, n_removed
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)"""


def templates() -> str:
    fits = []
    for verdict, rule in sorted(urls.RULES, key=lambda x: -len(x[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", rule, verdict))
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    levels = []
    for d in range(urls.DEPTH):
        child = f"seg[{d + 1}]" if d < urls.DEPTH - 1 else f"CASE WHEN len(seg) > {d} THEN array_to_string(seg[{d + 1}:], '/') END"
        levels.append(f"""
b{d} AS (
  SELECT *, {child} AS child, (sum(block) OVER node + {urls.PRIOR}::DOUBLE * up) / (sum(n) OVER node + {urls.PRIOR}::DOUBLE) AS share,
    sum(block) OVER branch AS cb, sum(n) OVER branch AS cn,
    (sum(block) FILTER ({child} IS NOT NULL) OVER node + 0.5::DOUBLE) / (sum(n) FILTER ({child} IS NOT NULL) OVER node + 1.0::DOUBLE) AS beside
  FROM t{d} WINDOW node AS (PARTITION BY host, prefix), branch AS (PARTITION BY host, prefix, {child})),
t{d + 1} AS (
  SELECT host, shape, n, block, seg, CASE WHEN child IS NULL THEN up ELSE share END AS up, CASE WHEN child IS NULL THEN prefix
    WHEN cn >= {urls.SUPPORT} AND abs((cb + 0.5::DOUBLE) / (cn + 1.0::DOUBLE) - beside) / sqrt(beside * (1 - beside) / greatest(cn, 1)) >= {urls.APART} THEN prefix || '/' || child
    ELSE prefix || '/*' END AS prefix
  FROM b{d}),""")
    last = f"t{urls.DEPTH}"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
x AS (SELECT *, {case(1)} AS rule, {case(2)} AS ruled, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape FROM p),
s AS (SELECT host, shape, count(ruled) AS n, count(*) FILTER (ruled = 'block') AS block FROM x GROUP BY host, shape),
t0 AS (SELECT *, string_split(regexp_replace(shape, '^/', ''), '/') AS seg, '' AS prefix, 0.5::DOUBLE AS up FROM s),{"".join(levels)}
judged AS (SELECT host, shape, prefix, (sum(block) OVER f + {urls.PRIOR}::DOUBLE * up) / (sum(n) OVER f + {urls.PRIOR}::DOUBLE) AS purity FROM {last} WINDOW f AS (PARTITION BY host, prefix))
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, prefix AS template, round(purity, 9) AS purity
FROM x JOIN judged USING (host, shape)"""


def audit() -> str:
    letters = ", ".join(f"('{c}', {1 << k})" for k, c in enumerate("ABCDE"))
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_words("coalesce(text, '')")} AS ws FROM documents),
m AS (
  SELECT doc_id, part, (len(ws) < 100)::INTEGER + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask
  FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
f(c, bit) AS (VALUES {letters}),
p AS (
  SELECT a.c || b.c || g.c || i.c || j.c AS filter_order, [a.bit, b.bit, g.bit, i.bit, j.bit] AS bits
  FROM f a, f b, f g, f i, f j WHERE len(list_distinct([a.c, b.c, g.c, i.c, j.c])) = 5),
o AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before FROM p, range(1, 6) t(step)),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
  FROM h, o GROUP BY ALL)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    return {"op7_count_min_substrings": passages(), "op8_line_quality": lines(), "op9_path_templates": templates(), "op12_filter_audit": audit()}
