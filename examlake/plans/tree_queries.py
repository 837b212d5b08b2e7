"""Folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from examlake.operators import merge, tree
from examlake.plans import inputs as I
from examlake.plans.catalog import query

_UP = f"WITH RECURSIVE {I.NODES_SQL}, {I.UP_SQL.replace('RECURSIVE_UP', 'up')}"


@query(_UP + " SELECT node_id, max(distance)::INT AS depth FROM up GROUP BY node_id")
def t1_depths(spark, d):
    return tree.with_depth(I.nodes(spark, d)).select("node_id", "depth")


@query(_UP + " SELECT node_id, ancestor_id, distance::INT AS distance FROM up")
def t2_ancestors(spark, d):
    return tree.ancestors(I.nodes(spark, d))


@query(_UP + " SELECT u.node_id, string_agg(n.name, '/' ORDER BY u.distance DESC) AS path FROM up u JOIN nodes n ON n.node_id = u.ancestor_id GROUP BY u.node_id")
def t3_paths(spark, d):
    return tree.paths(I.nodes(spark, d)).select("node_id", F.array_join("path", "/").alias("path"))


@query(_UP + ", hits AS (SELECT * FROM nodes WHERE contains(lower(name), 'n_1')) SELECT u.ancestor_id AS node_id FROM up u JOIN hits h ON h.node_id = u.node_id UNION SELECT u.node_id FROM up u JOIN hits h ON h.node_id = u.ancestor_id WHERE h.type = 'folder'".replace("n_1", "ion_1"))
def t4_search(spark, d):
    return tree.found(I.nodes(spark, d), " ION_1 ")


@query(_UP + " SELECT n.node_id, count(*) FILTER (u.distance > 0 AND m.type = 'folder') AS folders, count(*) FILTER (u.distance > 0 AND m.type = 'file') AS files FROM nodes n JOIN up u ON u.ancestor_id = n.node_id JOIN nodes m ON m.node_id = u.node_id GROUP BY n.node_id")
def t5_descendant_counts(spark, d):
    return tree.descendant_counts(I.nodes(spark, d))


_MOVES = """moves AS (SELECT 's' || s_suppkey AS node_id, CASE s_suppkey % 6 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN 'n' || s_nationkey WHEN 2 THEN 'n' || (s_suppkey % 25) WHEN 3 THEN 'c' || s_suppkey WHEN 4 THEN 'nowhere' ELSE 's' || (s_suppkey // 10 * 10) END AS to_id FROM supplier
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@query(_UP + f""", {_MOVES} SELECT m.node_id, m.to_id, CASE WHEN b.node_id IS NULL THEN 'unknown' WHEN m.node_id = m.to_id THEN 'self' WHEN b.type <> 'folder' THEN 'not_folder' WHEN a.section <> b.section THEN 'section'
WHEN EXISTS (SELECT 1 FROM up u WHERE u.node_id = m.to_id AND u.ancestor_id = m.node_id) THEN 'descendant' WHEN a.parent_id = m.to_id THEN 'current' END AS reason FROM moves m LEFT JOIN nodes a ON a.node_id = m.node_id LEFT JOIN nodes b ON b.node_id = m.to_id""")
def t6_moves(spark, d):
    s = I.table(spark, d, "supplier")
    m = s.selectExpr("concat('s', s_suppkey) as node_id", "case s_suppkey % 6 when 0 then concat('s', s_suppkey) when 1 then concat('n', s_nationkey) when 2 then concat('n', s_suppkey % 25) when 3 then concat('c', s_suppkey) when 4 then 'nowhere' else concat('s', s_suppkey div 10 * 10) end as to_id")
    return tree.moves_checked(I.nodes(spark, d), m.unionAll(s.selectExpr("concat('n', s_nationkey)", "concat('s', s_suppkey)")))


_PICKED = "picked AS (SELECT 's' || s_suppkey AS node_id FROM supplier WHERE s_suppkey % 3 = 0 UNION SELECT 'n1' UNION SELECT 'c2')"


def _picked(spark, d):
    s = I.table(spark, d, "supplier").filter("s_suppkey % 3 = 0").selectExpr("concat('s', s_suppkey) as node_id")
    n = I.table(spark, d, "nation").filter("n_nationkey = 1").selectExpr("concat('n', n_nationkey)")
    return s.unionAll(n).unionAll(I.table(spark, d, "customer").filter("c_custkey = 2").selectExpr("concat('c', c_custkey)"))


@query(_UP + f""", {_PICKED}, c AS (SELECT DISTINCT u.node_id FROM up u JOIN picked p ON p.node_id = u.ancestor_id), k AS (SELECT n.type, n.node_id IN (SELECT node_id FROM picked) AS own FROM c JOIN nodes n USING (node_id))
SELECT count(*) FILTER (type = 'folder' AND own) AS folders, count(*) FILTER (type = 'file' AND own) AS files, count(*) FILTER (type = 'folder' AND NOT own) AS more_folders, count(*) FILTER (type = 'file' AND NOT own) AS more_files, count(*) AS total FROM k""")
def a18_delete_summary(spark, d):
    return tree.delete_summary(I.nodes(spark, d), _picked(spark, d))


@query(_UP + f""", {_PICKED}, c AS (SELECT DISTINCT u.node_id FROM up u JOIN picked p ON p.node_id = u.ancestor_id), items AS (SELECT o_orderkey AS id, 's' || (o_orderkey % 40) AS note_id, 'c' || o_custkey AS source_node_id FROM orders)
SELECT id, note_id, CASE WHEN source_node_id IN (SELECT node_id FROM c) THEN NULL ELSE source_node_id END AS source_node_id FROM items WHERE note_id NOT IN (SELECT node_id FROM c)""")
def d8_cascade_note_items(spark, d):
    items = I.table(spark, d, "orders").selectExpr("o_orderkey as id", "concat('s', o_orderkey % 40) as note_id", "concat('c', o_custkey) as source_node_id")
    gone = tree.closure(I.nodes(spark, d), _picked(spark, d))
    return merge.cascaded({"note_items": items}, gone)["note_items"]


#: Names in both scripts: Hangul comes first, then Chinese signs, then Latin letters, of which case and accents do not count; numbers go by value.
_NAMES = ("c_custkey", "c_nationkey", "cast(c_custkey as string) as node_id", "if(c_custkey % 3 = 0, 'folder', 'file') as type", "concat(elt(c_custkey % 8 + 1, '가', '나', '漢', 'a', 'e', 'É', 'f', 'Z'), lpad('', c_custkey % 4, '0'), c_custkey % 100, if(c_custkey % 5 = 0 and c_custkey % 100 > 0, '00000000000000', ''), '장') as name")


@query("""WITH n AS (SELECT c_custkey, c_nationkey, c_custkey % 3 = 0 AS folder, CASE WHEN c_custkey % 8 > 4 THEN c_custkey % 8 - 1 ELSE c_custkey % 8 END AS head, ((c_custkey % 100)::HUGEINT * CASE WHEN c_custkey % 5 = 0 THEN 100000000000000 ELSE 1 END) AS k,
  ['가', '나', '漢', 'a', 'e', 'É', 'f', 'Z'][c_custkey % 8 + 1] || repeat('0', (c_custkey % 4)::INT) || (c_custkey % 100) || CASE WHEN c_custkey % 5 = 0 AND c_custkey % 100 > 0 THEN '00000000000000' ELSE '' END || '장' AS name FROM customer)
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN folder THEN 0 ELSE 1 END, head, k, name, c_custkey::VARCHAR) AS place FROM n""")
def o4_tree_order(spark, d):
    return tree.tree_order(I.table(spark, d, "customer").selectExpr(*_NAMES), ["c_nationkey"]).select("c_custkey", "place")


#: Folders with names in both scripts, by the number in the name and the script.
_SCRIPT_SQL = """named AS (SELECT node_id, type, CASE WHEN node_id LIKE 's%' AND substr(node_id, 2)::INT % 11 = 3 THEN NULL ELSE parent_id END AS parent_id, section,
  CASE WHEN substr(node_id, 2)::INT % 3 = 0 THEN '단원 ' ELSE 'Unit ' END || substr(node_id, 2) AS name, substr(node_id, 2)::INT % 3 > 0 AS latin, substr(node_id, 2)::INT AS k FROM nodes WHERE type = 'folder'),
moving AS (SELECT node_id FROM nodes WHERE node_id LIKE 's%' AND substr(node_id, 2)::INT % 7 = 2 UNION SELECT 'n3')"""


def _named(spark, d):
    n = I.nodes(spark, d)
    k = "cast(substr(node_id, 2) as int)"
    return n.selectExpr("node_id", "type", f"case when node_id like 's%' and {k} % 11 = 3 then null else parent_id end as parent_id", "section", f"if(type = 'file', name, concat(if({k} % 3 = 0, '단원 ', 'Unit '), {k})) as name")


@query(f"""WITH RECURSIVE {I.NODES_SQL}, {_SCRIPT_SQL},
own AS (SELECT f.*, p.node_id AS up FROM named f LEFT JOIN named p ON p.node_id = f.parent_id AND p.section = 'exam' WHERE f.section = 'exam'),
down AS (SELECT node_id, 0 AS depth, [(latin, k, node_id)] AS way FROM own WHERE up IS NULL UNION ALL SELECT o.node_id, d.depth + 1, list_append(d.way, (o.latin, o.k, o.node_id)) FROM down d JOIN own o ON o.up = d.node_id),
below AS (SELECT node_id FROM moving UNION SELECT n.node_id FROM below b JOIN named n ON n.parent_id = b.node_id),
here AS (SELECT min(parent_id) AS id FROM named WHERE node_id IN (SELECT node_id FROM moving) HAVING count(DISTINCT parent_id) = 1 AND count(*) = count(parent_id))
SELECT row_number() OVER (ORDER BY way) AS place, node_id, name, depth::INT AS depth, CASE WHEN node_id IN (SELECT node_id FROM moving) THEN 'self' WHEN node_id IN (SELECT node_id FROM below) THEN 'descendant' WHEN node_id = (SELECT id FROM here) THEN 'current' END AS reason
FROM down JOIN own USING (node_id) UNION ALL SELECT 0, NULL, '(최상위)', 0, NULL""")
def t6_move_targets(spark, d):
    n = _named(spark, d)
    return tree.move_targets(n, n.filter("node_id = 'n3' or (node_id like 's%' and cast(substr(node_id, 2) as int) % 7 = 2)").select("node_id"), "exam")
