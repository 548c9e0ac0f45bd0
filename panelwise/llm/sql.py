"""DuckDB texts of the queries that SQL can express."""

from __future__ import annotations

from panelwise.llm import source_mixing as mixing
from panelwise.llm.quality_divergence import DivergenceLimits


def _js(p: str, q: str) -> str:
    half = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * ln({a} / (({a} + {b}) / 2)) ELSE 0 END"
    pairs = f"list_zip({p}, {q})"
    term = f"{half('z[1]', 'z[2]')} + {half('z[2]', 'z[1]')}"
    return f"sqrt(greatest(0.0, list_sum(list_transform({pairs}, lambda z: {term})) / 2 / ln(2.0)))"


def quality_sql(limits: DivergenceLimits = DivergenceLimits()) -> str:
    space = r"'[\x20\x09-\x0D]+'"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS language, coalesce(text, '') AS text FROM documents),
c0 AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, regexp_replace(text, {space}, '', 'g') AS compact,
       list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c1 AS (SELECT *, regexp_replace(compact, '[a-z]+', '', 'g') AS r1 FROM c0),
c2 AS (SELECT *, regexp_replace(r1, '[A-Z]+', '', 'g') AS r2 FROM c1),
c3 AS (SELECT *, regexp_replace(r2, '[0-9]+', '', 'g') AS r3 FROM c2),
c4 AS (SELECT *, regexp_replace(r3, '[\x00-\x7F]+', '', 'g') AS r4 FROM c3),
c AS (SELECT r, doc_id, language, ws, len(ws) AS n_words, length(compact) AS word_chars,
      length(compact) - length(regexp_replace(compact, '[#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, length(text) AS n_all,
      [length(compact) - length(r1), length(r1) - length(r2), length(r2) - length(r3), length(text) - length(compact),
       length(r3) - length(r4), length(r4)] AS classes FROM c4),
g AS (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM c)),
f AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM f, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
big AS (SELECT * FROM c WHERE n_all >= {limits.min_chars}),
cls0 AS (SELECT language, count(*) AS n_documents, sum(n_words) AS total, [{', '.join(f'sum(classes[{i}])' for i in range(1, 7))}] AS sums, sum(n_all) AS chars FROM big GROUP BY language),
cls AS (SELECT language, total, list_transform(sums, lambda x: x / greatest(chars, 1)) AS class_share FROM cls0 WHERE n_documents >= {limits.min_documents}),
pool AS (SELECT [sum(sums[1] + sums[2] + sums[6]) / sum(chars), sum(sums[3]) / sum(chars), sum(sums[4]) / sum(chars), sum(sums[5]) / sum(chars)] AS pooled FROM cls0),
wc AS (SELECT language, word, count(*) AS n FROM (SELECT language, unnest(ws) AS word FROM big)
       WHERE regexp_matches(word, '^[^\x00-\x40\x5B-\x60\x7B-\x7F]+$') GROUP BY ALL),
top AS (SELECT * FROM wc QUALIFY row_number() OVER (PARTITION BY language ORDER BY n DESC, word) <= {limits.common_words}),
tops AS (SELECT language, list(word ORDER BY n DESC, word) AS common, list(n ORDER BY n DESC, word) AS ns FROM top GROUP BY language),
refs AS (SELECT cls.language, class_share, coalesce(common, []) AS common,
         list_append(list_transform(coalesce(ns, []), lambda n: n / greatest(total, 1)),
                     (total - coalesce(list_sum(ns), 0)) / greatest(total, 1)) AS common_share
         FROM cls LEFT JOIN tops USING (language)),
j AS (SELECT c.*, class_share, common, common_share, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM c LEFT JOIN refs USING (language) LEFT JOIN rep USING (r)),
h AS (SELECT r, list(coalesce(n, 0) ORDER BY k) AS counts FROM (
        SELECT j.r, k, common[k] AS word FROM j, (SELECT unnest(range(1, {limits.common_words} + 1)) AS k) WHERE k <= len(common)) x
      LEFT JOIN (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(ws) AS word FROM c) GROUP BY ALL) y USING (r, word) GROUP BY r),
k AS (SELECT j.*, list_append(coalesce(counts, []), n_words - coalesce(list_sum(counts), 0)) AS all_counts FROM j LEFT JOIN h USING (r)),
m AS (SELECT *, n_words < {limits.min_base_words} OR 100 * n_repeat_words > {limits.max_repeat_percent} * n_words AS base_failed,
      CASE WHEN n_all < {limits.min_chars} THEN NULL
           WHEN class_share IS NULL THEN {_js('[(classes[1] + classes[2] + classes[6]) / n_all, classes[3] / n_all, classes[4] / n_all, classes[5] / n_all]', 'pooled')}
           ELSE {_js('list_transform(classes, lambda x: x / n_all)', 'class_share')} END AS cd,
      CASE WHEN n_words >= {limits.min_words} AND class_share IS NOT NULL THEN {_js('list_transform(all_counts, lambda x: x / n_words)', 'common_share')} END AS wd FROM k, pool)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(cd > {limits.max_class_distance}, false) AND NOT coalesce(wd > {limits.max_word_distance}, false) AS kept
FROM m"""


def mixing_sql(seed: int = 42) -> str:
    block, modulus = mixing.BLOCK, mixing.MODULUS
    return rf"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':{seed}')) AS key FROM documents),
a AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS number FROM s GROUP BY source),
b AS (SELECT *, CAST([{', '.join(map(str, mixing.WEIGHTS))}][number % {len(mixing.WEIGHTS)} + 1] AS DOUBLE) AS weight,
      CAST({mixing.MOST} AS DOUBLE) * source_size AS lim FROM a),
c AS (SELECT *, (CAST({mixing.SHARE} AS DOUBLE) * sum(source_size) OVER ()
      - coalesce(sum(lim) OVER (ORDER BY lim / weight, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY lim / weight, number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
e AS (SELECT *, max(CASE WHEN level * weight <= lim THEN level END) OVER () AS final FROM c),
t AS (SELECT source, number, source_size, least(coalesce(final * weight, lim), lim) AS target FROM e),
i AS (SELECT *, CAST(round(sum(target) OVER (ORDER BY number) / sum(target) OVER () * {modulus}) AS BIGINT) AS hi FROM t),
j AS (SELECT *, coalesce(lag(hi) OVER (ORDER BY number), 0) AS lo FROM i),
p AS (SELECT slot, (slot % {modulus} + 1) * {mixing.STEP} % {modulus} AS point FROM (
      SELECT unnest(range(CAST(ceil((SELECT sum(target) FROM t) / {block}) AS BIGINT))) AS slot)),
r AS (SELECT number, source_size, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS rank FROM p JOIN j ON point >= lo AND point < hi),
u AS (SELECT number, rank % greatest((source_size + {block - 1}) // {block}, 1) AS block, count(*) AS uses FROM r
      WHERE rank // greatest((source_size + {block - 1}) // {block}, 1) < {mixing.MOST} GROUP BY ALL),
o AS (SELECT s.*, number, source_size, target,
      sum(size) OVER (PARTITION BY number ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
x AS (SELECT row_number() OVER () AS row_id, * FROM o),
k AS (SELECT row_id, unnest(range(CAST(start // {block} AS BIGINT), CAST((start + size - 1) // {block} AS BIGINT) + 1)) AS block FROM x WHERE size > 0),
y AS (SELECT k.row_id, sum((least(start + size, (k.block + 1) * {block}) - greatest(start, k.block * {block})) * coalesce(uses, 0)) AS taken
      FROM k JOIN x USING (row_id) LEFT JOIN u ON u.number = x.number AND u.block = k.block GROUP BY k.row_id)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM x LEFT JOIN y USING (row_id)"""


WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM q"""
