"""Queries of the general problems 2 and 6, and their SQL."""

from __future__ import annotations

from ontospark.operators.hierarchy import Hierarchy, term_links
from ontospark.operators.orphans import orphan_references, orphan_report
from ontospark.runtime import table


def _orphans(s, d):
    return orphan_references(*[table(s, d, t) for t in ("entities", "top_terms", "relations", "relation_pairs")])


def _tree(s, d) -> Hierarchy:
    return Hierarchy(term_links(table(s, d, "relations")))


def _paths(s, d):
    from pyspark.sql import functions as F

    return _tree(s, d).paths().select("node", F.array_join("path", " > ").alias("path"), "depth")


def queries() -> dict:
    return {
        "p2_found": lambda s, d: _orphans(s, d).select("tbl", "ref_key", "side").distinct(),
        "p2_report": lambda s, d: orphan_report(_orphans(s, d)),
        "p6_found": lambda s, d: _tree(s, d).nodes(),
        "p6_loops": lambda s, d: _tree(s, d).loops(),
        "p6_paths": _paths,
        "p6_descendants": lambda s, d: _tree(s, d).descendants(),
    }


_KEY = r"lower(trim(regexp_replace({}, '[ \t\r\n]+', ' ', 'g')))"

_OPEN = f"""
WITH spans AS (
  SELECT {_KEY.format('text_description')} AS k, added_at AS a, deleted_at AS b FROM entities
  UNION ALL SELECT {_KEY.format('term')}, added_at, NULL FROM top_terms),
named AS (
  SELECT DISTINCT * FROM (
    SELECT rel_id AS r, 'parent' AS side, {_KEY.format('parent')} AS k, added_at AS t FROM relations
    UNION ALL SELECT rel_id, 'child', {_KEY.format('child')}, added_at FROM relations)
  WHERE k IS NOT NULL AND k <> '' AND t IS NOT NULL AND r IS NOT NULL),
byid AS (
  SELECT DISTINCT * FROM (
    SELECT pair_id AS r, 'parent' AS side, parent_id AS k, added_at AS t FROM relation_pairs
    UNION ALL SELECT pair_id, 'child', child_id, added_at FROM relation_pairs)
  WHERE k IS NOT NULL AND t IS NOT NULL AND r IS NOT NULL),
found AS (
  SELECT 'relations' AS tbl, r AS ref_key, side, t FROM named n WHERE NOT EXISTS (
    SELECT 1 FROM spans s WHERE s.k = n.k AND s.a <= n.t AND (s.b IS NULL OR n.t < s.b))
  UNION ALL
  SELECT 'relation_pairs', CAST(r AS VARCHAR), side, t FROM byid n WHERE NOT EXISTS (
    SELECT 1 FROM entities s WHERE s.id = n.k AND s.added_at <= n.t AND (s.deleted_at IS NULL OR n.t < s.deleted_at)))
"""

_TREE = f"""
WITH RECURSIVE rows AS (
  SELECT {_KEY.format('child')} AS c, {_KEY.format('parent')} AS p, added_at, rel_id FROM relations),
links AS (
  SELECT c, arg_min(p, row(added_at IS NULL, added_at, rel_id IS NULL, rel_id, p)) AS p FROM rows WHERE c <> '' AND p <> '' GROUP BY c),
walk AS (
  SELECT c AS node, p AS root, CAST(1 AS BIGINT) AS depth, p || ' > ' || c AS path FROM links WHERE p NOT IN (SELECT c FROM links)
  UNION ALL
  SELECT l.c, w.root, w.depth + 1, w.path || ' > ' || l.c FROM walk w JOIN links l ON l.p = w.node)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _OPEN + "SELECT DISTINCT tbl, ref_key, side FROM found",
        "p2_report": _OPEN + "SELECT tbl, strftime(t, '%Y-%m') AS month, side, count(*) AS orphans FROM found GROUP BY ALL",
        "p6_found": _TREE + "SELECT node, root, depth FROM walk UNION ALL SELECT c, '(cycle)', -1 FROM links WHERE c NOT IN (SELECT node FROM walk)",
        "p6_loops": _TREE + """, bad AS (SELECT * FROM links WHERE c NOT IN (SELECT node FROM walk)),
          far AS (SELECT c AS s, p AS t FROM bad UNION SELECT s, bad.p FROM far JOIN bad ON bad.c = far.t)
          SELECT c AS node, p AS parent FROM bad WHERE EXISTS (SELECT 1 FROM far WHERE s = bad.c AND t = bad.c)""",
        "p6_descendants": _TREE + """, up AS (
            SELECT p AS node, c AS descendant, CAST(1 AS BIGINT) AS distance FROM links WHERE c IN (SELECT node FROM walk)
            UNION ALL SELECT l.p, up.descendant, up.distance + 1 FROM up JOIN links l ON l.c = up.node)
          SELECT node, descendant, distance FROM up""",
        "p6_paths": _TREE + "SELECT node, path, depth FROM walk",
    }
