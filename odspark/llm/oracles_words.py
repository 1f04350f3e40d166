"""DuckDB SQL of the secret scan, the Merkle manifest and the spelling variants."""

from __future__ import annotations

from odspark.llm import merkle, secret_ledger, variant_grams

# CRC-32: the table of 256 values from the reversed polynomial, folded over bytes
CRC_TABLE = """SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i))"""


def crc32(utf8: str) -> str:
    """Checksum of a list of byte values; needs the column crc of CRC_TABLE."""
    return (f"xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, {utf8}), "
            "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])))")


def bytes_of(text: str) -> str:
    """Byte values of a text of code points below 256."""
    return (f"flatten(list_transform(regexp_extract_all({text}, '.'), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] "
            "ELSE [192 + (ord(x) >> 6), 128 + (ord(x) & 63)]::BIGINT[] END))")


def secret_sql() -> str:
    def duck_pattern(rule):
        p = rule.pattern
        if rule.kind == "assign":  # ASCII letters in either case, without the wider case rules
            words, rest = p.removeprefix("(?i:(").split("))", 1)
            p = "(" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words) + ")" + rest
        return "'" + p.replace("'", "''") + "'"
    found = " UNION ALL ".join(
        f"SELECT n, '{r.kind}' AS kind, {k} AS k, regexp_extract_all(t, {duck_pattern(r)}) AS m, "
        f"regexp_extract_all(t, {duck_pattern(r)}, {r.group}) AS g, string_split_regex(t, {duck_pattern(r)}) AS p, "
        f"{r.least} AS least FROM d" for k, r in enumerate(secret_ledger.RULES))
    base = ", ".join(f"'{r.kind}'" for r in secret_ledger.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secret_ledger.BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
each AS (SELECT n, kind, k, least, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM found WHERE len(m) > 0),
spans AS (SELECT n, kind, k, length(m[i]) AS size,
  CAST(list_sum(list_transform(p[1:i], lambda x: length(x)))
       + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM each WHERE length(g[i]) >= least),
written AS (SELECT n, kind, k, s, kind || ':' || s || ':' || (s + size) AS w FROM spans),
by_doc AS (SELECT n, {counts}, string_agg(w, ',' ORDER BY s, k) FILTER (WHERE kind IN ({base})) AS base,
  string_agg(w, ',' ORDER BY s, k) AS spans FROM written GROUP BY n)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in secret_ledger.BASE)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_doc USING (n)"""


def merkle_sql() -> str:
    def leaf(**other):
        parts = [f"coalesce(strlen(CAST({other.get(c, c)} AS VARCHAR)) || ':' || {other.get(c, c)}, '-')" for c in merkle.FIELDS]
        return f"sha256({' || '.join(parts)})"
    grow = """SELECT g, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM {t} WHERE n > 1 GROUP BY g, level, pos // 2, n"""
    steps = """SELECT x.g, x.pos, a.level, CASE WHEN s.h IS NULL THEN '-' WHEN s.pos < a.pos THEN 'L' || s.h ELSE 'R' || s.h END AS step
  FROM {t} x JOIN {t} a ON a.g IS NOT DISTINCT FROM x.g AND a.n > 1 AND a.pos = x.pos >> a.level
  LEFT JOIN {t} s ON s.g IS NOT DISTINCT FROM a.g AND s.level = a.level AND s.pos = xor(a.pos, 1) WHERE x.level = 0"""
    return f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
leaves AS (SELECT lang, doc_id, {leaf()} AS leaf,
  CASE WHEN {crc32(bytes_of("CAST(doc_id AS VARCHAR)"))} % 7 = 0 THEN {leaf(n_chars="(n_chars + 1)")} END AS later
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes(g, level, pos, h, n) AS (SELECT lang, 0, pos, leaf, n FROM placed UNION ALL {grow.format(t="nodes")}),
tops AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1),
upper(g, level, pos, h, n) AS (SELECT 0, 0, pos, subroot, n FROM tops UNION ALL {grow.format(t="upper")}),
low AS ({steps.format(t="nodes")}),
high AS ({steps.format(t="upper")}),
low_steps AS (SELECT g, pos, list(step ORDER BY level) AS steps FROM low GROUP BY g, pos),
high_steps AS (SELECT pos, list(step ORDER BY level) AS steps FROM high GROUP BY pos),
proved AS (SELECT doc_id, leaf, subroot, (SELECT h FROM upper WHERE n = 1) AS root, later,
  coalesce(l.steps, []::VARCHAR[]) || coalesce(u.steps, []::VARCHAR[]) AS steps
  FROM placed p JOIN tops t ON t.lang IS NOT DISTINCT FROM p.lang
  LEFT JOIN low_steps l ON l.g IS NOT DISTINCT FROM p.lang AND l.pos = p.pos LEFT JOIN high_steps u ON u.pos = t.pos),
folded AS (SELECT *, list_reduce(list_prepend(coalesce(later, leaf), steps), lambda h, s:
  sha256(CASE s[1] WHEN 'L' THEN s[2:] || h WHEN 'R' THEN h || s[2:] ELSE h END)) AS folded_root FROM proved)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s[2:]), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded"""


def variants_sql() -> str:
    v = variant_grams
    return f"""
WITH RECURSIVE crc_table AS ({CRC_TABLE}),
tokens AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text,
  '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), '{v._UPPER}', '{v._LOWER}') AS run FROM documents),
runs AS (SELECT id, run, count(*) AS c FROM tokens WHERE length(run) >= {v.MIN_LENGTH} GROUP BY id, run),
hashed AS (SELECT run, c, {crc32(bytes_of("id || ':' || run"))} AS h FROM runs, crc_table),
slipped AS (SELECT c, CASE WHEN h % {v.SLIP} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= {v.MIN_LENGTH} GROUP BY word
  HAVING sum(c) >= {v.MIN_COUNT}),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut
  FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.cut = w.word
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.cut = w.word),
best AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n
  FROM near JOIN words ON words.word = b GROUP BY a),
forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {v.FACTOR} * n THEN form END AS form,
  CASE WHEN form_n >= {v.FACTOR} * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL
  SELECT chain.word, forms.form FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word
  JOIN forms e ON e.word = c.root AND e.form IS NULL"""


def all_sql() -> dict[str, str]:
    return {"op11_secret_scans": secret_sql(), "op12_merkle_manifest": merkle_sql(), "op13_spelling_variants": variants_sql()}
