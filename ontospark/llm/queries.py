"""The pN_ queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ontospark.llm import clusters, copies, leaks, mixing, neighbours, overlaps, reading
from ontospark.runtime import table


def queries() -> dict:
    return {
        "p1_found": lambda s, d: neighbours.similar_pairs(table(s, d, "entities")),
        "p1_nearest": lambda s, d: neighbours.nearest(table(s, d, "entities")),
        "p3_found": lambda s, d: clusters.cluster_members(table(s, d, "entities")),
        "p3_clusters": lambda s, d: clusters.cluster_report(table(s, d, "entities")).withColumn("typical", F.array_join(F.col("typical").cast("array<string>"), ",")),
        "p4_found": lambda s, d: overlaps.overlap_pairs(table(s, d, "entities")),
        "p4_report": lambda s, d: overlaps.overlap_report(table(s, d, "entities")),
        "p5_found": lambda s, d: copies.copy_links(table(s, d, "entities")),
        "p5_records": lambda s, d: copies.collapsed_records(table(s, d, "entities")),
        "p7_found": lambda s, d: leaks.leaked_passages(table(s, d, "documents"), table(s, d, "eval_items"), whole=False).select("doc_id", "item_id").distinct(),
        "p7_clean": lambda s, d: leaks.without_leaks(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "n_chars"),
        "p7_report": lambda s, d: leaks.leak_report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p8_mix": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).picks(),
        "p8_sources": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).sources(),
        "p8_shares": lambda s, d: mixing.Mix(table(s, d, "documents"), table(s, d, "mix_targets")).shares(),
        "p9_found": lambda s, d: reading.reading_bands(table(s, d, "documents")),
        "p9_profile": lambda s, d: reading.reading_profile(table(s, d, "documents")),
    }


_RECORDS = r"""
WITH e AS (
  SELECT id, text_description AS t, CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS g
  FROM entities WHERE regexp_matches(text_description, '[^ \t\r\n\f\v]')),
k AS (
  SELECT *, array_to_string(list_sort(list_filter(regexp_split_to_array(
    regexp_replace(lower(t), '[^\p{L}\p{N};|\r\n]+', '', 'g'), '[;|\r\n]+'), lambda x: x <> '')), ';') AS key FROM e)
"""

_OVERLAPS = r"""
WITH w AS (
  SELECT id, lower(trim(split_name)) AS s, CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS g,
    list_distinct(regexp_split_to_array(trim(regexp_replace(lower(text_description), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS ws
  FROM entities WHERE regexp_matches(text_description, '[\p{L}\p{N}]')),
x AS (SELECT id, s, unnest(ws) AS word, len(ws) AS n FROM w WHERE s IN ('train', 'test', 'dev')),
c AS (
  SELECT a.id AS e, b.id AS t, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS same
  FROM x a JOIN x b ON a.word = b.word AND a.s <> 'train' AND b.s = 'train' AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY a.id, b.id),
hit AS (SELECT e, t, (n = same AND m = same) AS equal FROM c WHERE 10 * same >= 8 * (n + m - same))
"""

_LEAKS = r"""
WITH i AS (
  SELECT item_id, regexp_split_to_array(trim(regexp_replace(lower(item_text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items),
g AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 7], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 6)) AS s FROM i)),
d AS (
  SELECT doc_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 7], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 6)) AS s FROM d))
SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (p)
"""

# runs of eight words, put together where both move on by one word; an item of fewer words as a whole
_LEAKS_LONG = r"""
WITH i AS (
  SELECT item_id, regexp_split_to_array(trim(regexp_replace(lower(item_text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM eval_items),
g AS (SELECT item_id, s, array_to_string(w[s:s + 7], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 6)) AS s FROM i)),
d AS (
  SELECT doc_id, regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, s AS t, array_to_string(w[s:s + 7], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - 6)) AS s FROM d)),
x AS (SELECT doc_id, item_id, s, t, t - row_number() OVER (PARTITION BY doc_id, item_id, t - s ORDER BY t) AS run FROM g JOIN h USING (p)),
m AS (
  SELECT doc_id, item_id, count(*) + 7 AS words FROM x GROUP BY doc_id, item_id, t - s, run
  UNION ALL
  SELECT doc_id, item_id, len(i.w) FROM i JOIN d ON len(i.w) < 8 AND i.w[1] <> '' AND contains(concat(' ', array_to_string(d.w, ' '), ' '), concat(' ', array_to_string(i.w, ' '), ' ')))
"""

_BANDS = r"""
WITH d AS (
  SELECT doc_id, text, len(regexp_split_to_array(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')) AS n,
    length(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS c,
    len(list_filter(regexp_split_to_array(text, '[.!?](\s+|$)'), lambda x: regexp_matches(x, '[\p{L}\p{N}]'))) AS s
  FROM documents WHERE lower(trim(lang)) LIKE 'en%' AND regexp_matches(text, '[\p{L}\p{N}]'))
SELECT DISTINCT doc_id, reading_band FROM (
  SELECT doc_id, CASE WHEN n <= 10 * s AND c <= 4.4 * n THEN 'basic' WHEN n >= 21 * s AND c >= 5.9 * n THEN 'advanced' END AS reading_band FROM d WHERE n >= 30)
WHERE reading_band IS NOT NULL
"""


_CLUSTERS = """
WITH RECURSIVE u AS (
  SELECT id, CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS g, CAST(embedding AS DOUBLE[]) AS e
  FROM entities WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: isfinite(x))) = 128 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
v AS (SELECT id, g, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS x FROM u),
e AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.g = b.g AND a.id <> b.id AND list_dot_product(a.x, b.x) >= 0.70),
cc(node, low) USING KEY (node) AS (
  SELECT id, id FROM v
  UNION
  (SELECT e.b, min(c.low) FROM cc c JOIN e ON e.a = c.node JOIN recurring.cc r ON r.node = e.b AND c.low < r.low GROUP BY e.b)),
m AS (SELECT node AS id, low AS cluster_id, count(*) OVER (PARTITION BY low) AS n FROM cc QUALIFY n >= 5)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _CLUSTERS + "SELECT id, cluster_id FROM m",
        "p3_clusters": _CLUSTERS + """,
          d AS (SELECT v.id, g, cluster_id, n, list_transform(x, lambda y: abs(y)) AS s, list_max(s) AS depth, list_position(s, depth) AS axis, 2 * (axis - 1) + CAST(x[axis] < 0 AS INTEGER) AS home FROM v JOIN m USING (id)),
          h AS (SELECT cluster_id, home, count(*) AS c FROM d GROUP BY ALL),
          t AS (SELECT cluster_id, max(c) AS densest_n, arg_min(home, row(-c, home)) AS home FROM h GROUP BY cluster_id),
          r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY depth DESC, id) AS rank FROM d JOIN t USING (cluster_id, home) QUALIFY rank <= 3)
          SELECT g AS dataset, cluster_id, max(n) AS n, max(densest_n) AS densest_n, array_to_string(list(id ORDER BY rank), ',') AS typical FROM r GROUP BY ALL""",
        "p4_found": _OVERLAPS + "SELECT least(e, t) AS id_a, greatest(e, t) AS id_b FROM hit",
        "p4_report": _OVERLAPS + """SELECT s AS split, g AS dataset, count(*) AS records, count(q.e) AS overlapping, coalesce(sum(CAST(q.equal AS BIGINT)), 0)::BIGINT AS exact
          FROM w LEFT JOIN (SELECT e, bool_or(equal) AS equal FROM hit GROUP BY e) q ON w.id = q.e WHERE s IN ('test', 'dev') GROUP BY 1, 2""",
        "p5_found": _RECORDS + "SELECT keep_id, id AS copy_id FROM (SELECT id, min(id) OVER (PARTITION BY g, key) AS keep_id FROM k) WHERE id <> keep_id",
        "p5_records": _RECORDS + "SELECT g AS dataset, min(id) AS keep_id, count(*) AS copies, count(DISTINCT t) AS variants FROM k GROUP BY g, key",
        "p7_found": _LEAKS,
        "p7_report": _LEAKS_LONG + "SELECT item_id, count(DISTINCT doc_id) AS docs, max(words) AS longest FROM m GROUP BY item_id",
        "p7_clean": _LEAKS_LONG + "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)",
        "p8_sources": """WITH g AS (SELECT lower(trim(source)) AS source, max(target_share) AS target_share, max(max_repeats)::BIGINT AS max_repeats FROM mix_targets GROUP BY 1),
          t AS (SELECT text, arg_min(s, doc_id) AS source FROM (SELECT doc_id, text, regexp_replace(lower(trim(source)), '[- ]', '_', 'g') AS s FROM documents WHERE length(text) > 0)
            WHERE s IN (SELECT source FROM g) GROUP BY text)
          SELECT g.source, target_share, max_repeats, count(text) AS docs FROM g LEFT JOIN t USING (source) GROUP BY ALL""",
        "p9_found": _BANDS,
    }
