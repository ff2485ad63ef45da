"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

from lumenflow.llm.mixing import MixConfig
from lumenflow.llm.quality_rules import QualityConfig

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def mixing_sql(config: MixConfig = MixConfig()) -> str:
    weights = ", ".join(map(str, config.weights))
    unit = f"('0x' || substr(md5('{config.seed}:' || {{}}), 1, 8))::BIGINT"
    offsets = "\nUNION ALL ".join(
        f"SELECT source, {k} AS k, " + unit.format(f"coalesce('{k}s' || source, '{k}null')") + " / 4294967296.0::DOUBLE AS u FROM goal"
        for k in range(config.offsets)
    )
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS grade,
    {unit.format("coalesce(doc_id::VARCHAR, '')")} % {config.buckets} AS bucket FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY grade DESC, bucket, doc_id, size) AS place FROM keyed),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM sizes),
capped AS (
  SELECT *, [{weights}][(n % {len(config.weights)} + 1)::INT] AS weight, {config.repeats} * source_size AS most FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM capped WINDOW before AS (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goal AS (
  SELECT source, source_size, coalesce(
    least(max(level) FILTER (level * weight <= most) OVER () * weight, most::DOUBLE), most::DOUBLE) AS target FROM levels),
offsets AS ({offsets}),
tried AS (
  SELECT o.source, o.k, o.u, abs(sum((floor(r * place + u) - floor(r * (place - 1) + u)) * size)
    - any_value(target)) AS miss
  FROM (SELECT p.*, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS r
        FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source) p
  JOIN offsets o ON p.source IS NOT DISTINCT FROM o.source GROUP BY ALL),
best AS (SELECT source, arg_min(u, (miss, k)) AS u FROM tried GROUP BY source)
SELECT doc_id, size, source_size, target,
  ((floor(r * place + u) - floor(r * (place - 1) + u))::BIGINT * size)::BIGINT AS taken
FROM (SELECT p.doc_id, p.size, p.place, g.source_size, g.target, b.u,
        CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS r
      FROM placed p JOIN goal g ON p.source IS NOT DISTINCT FROM g.source
      JOIN best b ON p.source IS NOT DISTINCT FROM b.source)
"""


URL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
rules(verdict, rule, h, p) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fits AS (
  SELECT host, path, arg_max((verdict, rule), length(rule)) AS best
  FROM (SELECT DISTINCT host, path FROM parsed) JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, host, path, best[2] AS rule, coalesce(best[1], 'allow') AS verdict
FROM parsed LEFT JOIN fits USING (host, path)
"""


def quality_sql(config: QualityConfig = QualityConfig()) -> str:
    width = len(config.rules)
    js = range(width)
    votes = ", ".join(
        f"CASE WHEN {r.bad} THEN 1 WHEN {r.good} THEN 2 ELSE 0 END AS v{j}" for j, r in enumerate(config.rules)
    )
    names = ", ".join(f"v{j}" for j in js)

    def chance(params: str) -> str:
        terms = " + ".join(
            f"CASE v{j} WHEN 1 THEN ln({params}.a{j} / {params}.b{j})"
            f" WHEN 2 THEN ln((1 - {params}.a{j}) / (1 - {params}.b{j})) ELSE 0 END"
            for j in js
        )
        return f"1 / (1 + exp(-(ln({params}.s / (1 - {params}.s)) + {terms})))"

    def rate(weight: str, j: int, bounds: tuple[float, float, float]) -> str:
        start, least, most = bounds
        cast = f"sum({weight}) FILTER (v{j} > 0)"
        return (
            f"CASE WHEN coalesce({cast}, 0) > 0 THEN least(greatest(coalesce(sum({weight}) FILTER (v{j} = 1), 0)"
            f" / {cast}, {least}), {most}) ELSE {start} END"
        )

    start = ", ".join(f"{config.false_alarm[0]}::DOUBLE AS a{j}, {config.notice[0]}::DOUBLE AS b{j}" for j in js)
    rounds = [f"r0 AS (SELECT {config.good_share}::DOUBLE AS s, {start})"]
    for k in range(1, config.rounds + 1):
        rates = ", ".join(
            f"{rate('n * g', j, config.false_alarm)} AS a{j}, {rate('n * (1 - g)', j, config.notice)} AS b{j}" for j in js
        )
        rounds.append(
            f"r{k} AS (SELECT least(greatest(sum(n * g) / sum(n), 0.05), 0.95) AS s, {rates}"
            f" FROM (SELECT p.*, {chance('q')} AS g FROM patterns p, r{k - 1} q))"
        )
    last = f"r{config.rounds}"
    text = "coalesce(text, '')"
    blank = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, {text} AS t, row_number() OVER () AS k FROM documents),
w AS (SELECT k, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT k, regexp_extract_all(t, '{WORD}') AS ws FROM d)),
g AS (SELECT k, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT k, count(DISTINCT i + s) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) AS t(s) GROUP BY k),
l AS (SELECT k, l FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE translate(l, {blank}, '') <> ''),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM l GROUP BY k),
m AS MATERIALIZED (
  SELECT d.k, doc_id, len(regexp_extract_all(t, '{WORD}'))::BIGINT AS n_words, length(translate(t, {blank}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_upper,
    length(t)::BIGINT AS n_chars, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (k) LEFT JOIN covered USING (k)),
v AS MATERIALIZED (SELECT *, {votes} FROM m),
patterns AS MATERIALIZED (SELECT {names}, count(*)::DOUBLE AS n FROM v GROUP BY ALL),
{", ".join(rounds)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND g >= {config.cut} AS kept
FROM (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {chance('q')} AS g FROM v, {last} q)
"""


TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def collocations_sql(least: int = 100, top: int = 2000) -> str:
    leads = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, 5))
    grams = "\nUNION ALL ".join(
        f"SELECT lang, {n} AS words, list_value({', '.join(['w', *(f'w{k}' for k in range(1, n))])}) AS g FROM s"
        f" WHERE {f'w{n - 1} IS NOT NULL' if n > 1 else 'true'}"
        for n in range(1, 6)
    )
    return f"""
WITH p AS (
  SELECT row_number() OVER () AS k, lang, piece FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(regexp_split_to_array(translate(coalesce(text, ''), {CAPITALS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
w AS (SELECT k, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT k, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p)),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
s AS (SELECT lang, w, {leads} FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
f AS MATERIALIZED (SELECT lang, words, g, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {least}),
covered AS (SELECT DISTINCT lang, g, f FROM (
  SELECT lang, g[1:words - 1] AS g, f FROM f WHERE words > 2 UNION ALL SELECT lang, g[2:words] AS g, f FROM f WHERE words > 2)),
opened AS (SELECT * FROM f WHERE words > 1 AND NOT EXISTS (
  SELECT 1 FROM covered c WHERE c.lang = f.lang AND c.g = f.g AND c.f = f.f)),
cut AS (
  SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, words)) AS k FROM opened) c JOIN totals t ON c.lang = t.lang
  JOIN f l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1:c.words]),
lowest AS (SELECT lang, g, any_value(a) AS a, any_value(n) AS n, min((score, k, l, r)) AS x FROM cut GROUP BY lang, g),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, x[3] AS l, x[4] AS r, n, x[1] AS score FROM lowest)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked)
WHERE rank <= {top}
"""


LINES = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT k, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {CAPITALS}) AS key FROM l),
firsts AS (SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k, doc_id, line, i, coalesce(doc_id IS NULL AND first IS NOT NULL OR doc_id > first, false) AS goes
  FROM keyed LEFT JOIN firsts USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY k
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), {CAPITALS}), '{TERM}') AS ws FROM documents),
c AS (SELECT count(*) AS docs, sum(len(ws)) AS words FROM d WHERE len(ws) > 0),
p AS (SELECT k, doc_id, own, t, count(*) AS tf FROM (SELECT k, doc_id, len(ws) AS own, unnest(ws) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t, docs),
q AS (SELECT i, item_id, t, count(*) AS repeats FROM (
  SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {CAPITALS}), '{TERM}')) AS t
  FROM benchmark) GROUP BY ALL),
s AS (
  SELECT i, item_id, k, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * own * docs) // words))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t), c GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""

ORACLE: dict[str, str] = {
    "op1_mixing": mixing_sql(),
    "op5_url_filters": URL,
    "op7_quality_rules": quality_sql(),
    "op10_top_k": TOP_K,
    "op11_collocations": collocations_sql(),
    "op12_line_dedup": LINES,
    "op13_lexical_search": LEXICAL,
}
