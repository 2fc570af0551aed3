"""SQL that gives the rows of the registered queries, for those that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

_QUALITY = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w
  FROM documents
),
lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t
),
places AS (
  SELECT r, unnest(generate_series(1, len(w) - 2)) AS i, w FROM t WHERE len(w) >= 3
),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places
),
repeats AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM windows, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r
),
measured AS (
  SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: NOT regexp_matches(x, '\pL'))) AS BIGINT) AS n_plain_words,
         CAST(len(regexp_extract_all(text, '\p{{Lu}}')) AS BIGINT) AS n_upper,
         CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclaim
  FROM t JOIN lines USING (r) LEFT JOIN repeats USING (r)
),
bits AS (
  SELECT *,
    (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (100 * n_dup_lines > 30 * n_lines)::BIGINT + 16 * (word_chars < 3 * n_words)::BIGINT
    + 32 * (word_chars > 12 * n_words)::BIGINT + 64 * (100 * n_plain_words > 20 * n_words)::BIGINT
    + 128 * (100 * n_upper > 30 * word_chars)::BIGINT + 256 * (2 * n_exclaim > n_words)::BIGINT AS fail_bits
  FROM measured
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, fail_bits = 0 AS kept FROM bits
"""

# Sources sorted by how soon they reach three times their size: the first k are clamped, the others share what is left.
_MIX = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
),
ranked AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s),
levels AS (
  SELECT k, weight, source_size,
         (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS budget,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM ranked
),
fill AS (
  SELECT budget, weights FROM levels WHERE 3 * source_size * weights > weight * budget ORDER BY k LIMIT 1
),
goal AS (
  SELECT source, source_size,
         coalesce((SELECT least(CAST(3 * source_size AS DOUBLE), CAST(weight * budget AS DOUBLE) / CAST(weights AS DOUBLE)) FROM fill),
                  CAST(3 * source_size AS DOUBLE)) AS target
  FROM s
),
ordered AS (
  SELECT d.*, source_size, target,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
         CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole
  FROM d JOIN goal ON d.source IS NOT DISTINCT FROM goal.source
),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(whole AS BIGINT)
         + CASE WHEN target - source_size * whole > 0 AND 2 * earlier + size <= 2 * (target - source_size * whole) THEN 1 ELSE 0 END
         END AS copies
  FROM ordered
)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM counted
"""


def _both_cases(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_both_cases(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRET_KINDS = [
    # kind, pattern, group of the value within it, least length
    ("assign", rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.~=-]+)", 1, 16),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 32),
    ("forge", "gh[opsu]_[A-Za-z0-9]+", 0, 24),
    ("login", r"[a-z][a-z0-9+]*://[^\x20\x09-\x0D/:@]+:([^\x20\x09-\x0D/:@]+)@", 1, 4),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+", 0, 48),
]


def _kind_rows(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    split = f"(?s)(.*?)({pattern})"
    return f"""
  SELECT r, source, lang, {rank} AS rank, '{kind}' AS kind, a AS start, a + length(m) AS stop, v AS value FROM (
    SELECT r, source, lang, i, m, v, length(g) + coalesce(sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
    FROM (
      SELECT r, source, lang, unnest(generate_series(1, len(g))) AS i, unnest(g) AS g, unnest(m) AS m, unnest(v) AS v
      FROM (SELECT r, source, lang, regexp_extract_all(text, '{split}', 1) AS g, regexp_extract_all(text, '{split}', 2) AS m,
                   regexp_extract_all(text, '{split}', {2 + group}) AS v FROM t)))
  WHERE length(v) >= {least}"""


_SECRETS = f"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
spans AS ({" UNION ALL ".join(_kind_rows(k, *kind) for k, kind in enumerate(_SECRET_KINDS))}),
owners AS (
  SELECT value, CASE WHEN count(DISTINCT coalesce('=' || source, 'none')) >= 2 THEN 'shared'
                WHEN length(value) >= 12 AND len(list_distinct(string_split(value, ''))) >= 6 THEN 'live' ELSE 'weak' END AS class
  FROM spans GROUP BY value
),
per AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) FILTER (rank < 3) AS base,
         string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans,
         count(*) FILTER (class = 'live') AS n_live, count(*) FILTER (class = 'shared') AS n_shared
  FROM spans JOIN owners USING (value) GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM t LEFT JOIN per USING (r)
"""

_WARC = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages
),
d AS (SELECT page_id, url, octet_length(body) AS n, sha1(body) AS digest FROM p),
l AS (SELECT digest, max(page_id) AS leader FROM d WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN leader IS NOT NULL AND page_id IS DISTINCT FROM leader THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM leader THEN leader END AS refers_to, coalesce(url, '') AS url
FROM d LEFT JOIN l ON n >= 1000 AND d.digest = l.digest
"""

# Grams of 1 to 4 words counted directly within pieces; candidates, cuts, containment and the top list per language.
_COLLOCATIONS = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, len, array_to_string(w[i:i + len - 1], ' ') AS phrase
  FROM (SELECT lang, w, len, unnest(generate_series(1, len(w) - len + 1)) AS i
        FROM w, (VALUES (1), (2), (3), (4)) AS v(len) WHERE len(w) >= len)
),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY lang, len, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a FROM f WHERE len >= 2 AND f >= 30),
cuts AS (
  SELECT c.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp,
         array_to_string(string_split(phrase, ' ')[k + 1:len], ' ') AS rp
  FROM c, (VALUES (1), (2), (3)) AS v(k) WHERE k < len
),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.len, a, k, fl.f AS l, fr.f AS r,
         CAST((CAST(a AS HUGEINT) * 2000000) // (fl.f + fr.f) AS BIGINT) AS score
  FROM cuts JOIN f AS fl ON fl.lang = cuts.lang AND fl.phrase = cuts.lp
            JOIN f AS fr ON fr.lang = cuts.lang AND fr.phrase = cuts.rp
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM scored) WHERE o = 1
),
inner_parts AS (
  SELECT c.lang, c.a AS longer, array_to_string(string_split(c.phrase, ' ')[s:s + m - 1], ' ') AS part
  FROM c, (VALUES (2), (3)) AS u(m), (VALUES (1), (2), (3)) AS v(s) WHERE m < c.len AND s + m - 1 <= c.len
),
kept AS (
  SELECT * FROM best
  WHERE NOT EXISTS (SELECT 1 FROM inner_parts AS i WHERE i.lang = best.lang AND i.part = best.phrase AND 100 * i.longer >= 80 * best.a)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT ranked.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       score, CAST(k AS BIGINT) AS k, CAST(len AS BIGINT) AS words
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": _QUALITY,
    "op3_warc": _WARC,
    "op9_mixing": _MIX,
    "op10_secret_scan": _SECRETS,
    "op13_collocations": _COLLOCATIONS,
}
