"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

#: Patterns of the secret rules in the other engine's syntax, and the least length of what must be long.
SECRETS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    ("hook", r"https://hooks\.[a-z0-9.-]+/services/[A-Za-z0-9/]{20,}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _matches(order: int, name: str, pattern: str, group: int, least: int) -> str:
    """Matches are marked, the text is cut at the marks, and lengths before a piece add up to its place."""
    return f"""SELECT doc_id, {order} AS ord, '{name}' AS kind, start, start + length(m) AS stop FROM (
      SELECT doc_id, i, split_part(piece, chr(2), 1) AS m, sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - (length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) AS start
      FROM (SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM d))
    ) WHERE i > 1 AND length(regexp_extract(m, '{pattern}', {group})) >= {least}"""


_ALL = "\n    UNION ALL ".join(_matches(n, *s) for n, s in enumerate(SECRETS))
_JOINED = "coalesce(string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord){0}, '')"
_COUNTS = ", ".join(f"count(kind) FILTER (kind = '{s[0]}') AS n_{s[0]}" for s in SECRETS[:3])
SECRET_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (
    {_ALL})
  SELECT d.doc_id, {_COUNTS}, sha256({_JOINED.format(" FILTER (ord < 3)")}) AS base_sha256, {_JOINED.format("")} AS spans, sha256(any_value(t)) AS blob_id
  FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id"""

QUALITY_SQL = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
  x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
  tri AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER p || ' ' || lead(word, 2) OVER p AS g FROM x WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
  rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM tri WHERE g IS NOT NULL) WHERE c > 1),
  cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
  m AS (SELECT w.doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
  f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
  s AS (SELECT *, base_failed OR (n_words > 0 AND (n_symbols / greatest(n_words, 1) > 0.1 OR n_dup_lines > 0.3 * n_lines OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15)) AS soft_failed FROM f),
  h AS (SELECT source, count(*) AS n, count(*) FILTER (soft_failed) AS bad FROM s GROUP BY source),
  p AS (SELECT sum(bad) / sum(n) AS m, sum(n) AS n, count(*) AS k, sum(n * (bad / n) * (bad / n)) AS q FROM h),
  b AS (SELECT *, greatest(q / n - m * m - m * (1 - m) * k / n, 0) AS between_hosts FROM p),
  a AS (SELECT m, CASE WHEN between_hosts > 0 THEN greatest(m * (1 - m) / between_hosts - 1, 1) ELSE n END AS weight FROM b),
  j AS (SELECT source, (bad + m * weight) / (n + weight) AS rate FROM h, a)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > 0.5 AND soft_failed) AS kept, soft_failed, round(rate, 6) AS host_rate, rate > 0.5 AS host_bad
  FROM s JOIN j ON s.source IS NOT DISTINCT FROM j.source"""

ORACLES = {"op1_secret_scan": SECRET_SQL, "op5_quality_rules": QUALITY_SQL}
