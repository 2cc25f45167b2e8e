"""DuckDB SQL for the queries that SQL can express."""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, greatest(len(ws) - 6, 1))) AS i, ws FROM w),
h AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM g),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM h) WHERE c > 1),
p AS (SELECT rid, sum(least(8, coalesce(n - i, 8))) AS n_repeat FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM r) GROUP BY rid),
c AS (SELECT w.doc_id, w.source, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
  coalesce(n_repeat, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT)::DOUBLE AS f FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT count(*) AS k, sum(n) AS n, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) AS ff FROM hosts),
v AS (SELECT mean, CASE WHEN k < n THEN (ff - mean * mean - mean * (1 - mean) * k / n) / (1 - k / n) ELSE 0 END AS between_hosts FROM m),
q AS (SELECT mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1 ELSE 1e6 END, 1), 1e6) AS weight FROM v),
bad AS (SELECT source FROM hosts, q WHERE (f + mean * weight) / (n + weight) > 0.5)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(source NOT IN (SELECT source FROM bad), true) AS kept FROM b
"""

OP3 = """
WITH d AS (SELECT *, coalesce('s:' || source, 'null') AS k, (('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT k, count(*)::DOUBLE AS n, pow(count(*)::DOUBLE, 0.7::DOUBLE) AS w FROM d GROUP BY k),
r AS (SELECT k, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM s),
p AS (SELECT k, sum(exp(-rate + i * ln(rate) - lgamma(i + 1))) OVER (PARTITION BY k ORDER BY i) AS c FROM r, range(0, 1000) t(i) WHERE i <= ceil(rate + 12 * sqrt(rate) + 30)),
m AS (SELECT u, k, count(*) FILTER (c < u) AS n FROM (SELECT DISTINCT u, k FROM d) JOIN p USING (k) GROUP BY u, k),
c AS (SELECT d.*, unnest(range(1, m.n + 1))::INT AS copy FROM d JOIN m ON d.k = m.k AND d.u = m.u)
SELECT doc_id, text, lang, source, n_chars, copy, md5('42|copy|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS shuffle_key FROM c
"""

ORACLES = {"op3_poisson_mixing": OP3, "op8_host_quality_rules": OP8}
