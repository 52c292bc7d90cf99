"""Graph data sets: edges between siblings, roots, super-nodes, offsets, splits, negative edges, hierarchies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators.closure import closure, components
from knotwork.operators.sampling import nth_smallest
from knotwork.session import stage_table, table


def followed_by(df: DataFrame, parent: str, order: list[str], child: Column) -> DataFrame:
    """(parent, src, dst) between consecutive children of a parent."""
    w = Window.partitionBy(parent).orderBy(*order)
    return df.select(parent, F.lag(child).over(w).alias("src"), child.alias("dst")).filter("src is not null")


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that no edge enters."""
    return edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges, the lesser end first, without loops."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).filter("src <> dst").distinct()


def with_supernode(edges: DataFrame, name: str = "supernode") -> DataFrame:
    """Edges and, per graph, one from a super-node to every node."""
    nodes = edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", "dst")).distinct()
    return edges.select("graph_id", "src", "dst").union(nodes.select("graph_id", F.lit(name), "node"))


def block_offsets(sizes: DataFrame, graph: str = "graph_id", size: str = "size", buckets: int = 1024) -> DataFrame:
    """(graph, size, first, supernode): where each graph's block begins in the common matrix; its super-node is last.

    Prefix sums in two levels: blocks of consecutive graph ids are summed first, and only these few sums are ordered
    in one task, so no task has to sort all graphs.
    """
    bucketed = sizes.withColumn("_b", F.floor(F.col(graph) / buckets))
    tops = bucketed.groupBy("_b").agg(F.sum(size).alias("_sum"))
    before = tops.select("_b", (F.sum("_sum").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"))
    inner = F.sum(size).over(Window.partitionBy("_b").orderBy(graph).rowsBetween(Window.unboundedPreceding, 0))
    out = bucketed.withColumn("_run", inner).join(before, "_b")
    return out.select(graph, size, (F.col("_before") + F.col("_run") - F.col(size)).alias("first"), (F.col("_before") + F.col("_run") - 1).alias("supernode"))


def masks(offsets: DataFrame, train: float = 0.8, valid: float = 1.0) -> DataFrame:
    """(graph_id, first, supernode, n_train, n_val): how many rows of each block the training and validation masks hold.

    Rows before the super-node of the graph at the training share less one are for training, rows from it to that of
    the validation share less one for validation, super-nodes are tested; the off-by-one is part of the definition.
    """
    n = offsets.count()
    t, v = (x or 0 for x in nth_smallest(offsets, F.col("supernode"), [max(1, math.ceil(n * train)), max(1, math.ceil(n * valid))]))
    clip = lambda lo, hi: F.greatest(F.lit(0), F.least(F.col("first") + F.col("size"), hi) - F.greatest(F.col("first"), lo))
    return offsets.select("graph_id", "first", "supernode", clip(F.lit(0), F.lit(t - 1)).alias("n_train"), clip(F.lit(t), F.lit(v - 1)).alias("n_val"))


def hash_split(key: Column, test: int, valid: int, parts: int = 100) -> Column:
    """train, valid or test by arithmetic on a whole number, the same in every engine and at every size."""
    turn = F.pmod(key * 7919 + 104729, F.lit(parts))
    return F.when(turn < test, "test").when(turn < test + valid, "valid").otherwise("train")


#: A prime above any number of nodes; its multiples walk through all ordered pairs of nodes.
WALK = 2_147_483_647


def negative_edges(edges: DataFrame, share: float = 0.1, wanted: int | None = None) -> DataFrame:
    """(src, dst), src < dst: pairs of nodes that are no edge in either direction, as many as ``share`` of the edges or ``wanted``.

    Nodes are numbered from 0 to the largest end. Candidate k is the pair number k x ``WALK`` modulo all ordered pairs, a
    permutation, so no pair comes twice; candidates are made in growing ranges until enough are free or all were looked at.
    """
    spark = edges.sparkSession
    known = undirected(edges)
    nodes, count = known.agg(F.max("dst") + 1, F.count(F.lit(1))).first()
    wanted = int(count * share) if wanted is None else wanted
    nodes = nodes or 0
    every = nodes * nodes
    reach = 4 * wanted
    while True:
        turn = F.pmod(F.col("id") * WALK, F.lit(max(every, 1)))
        pairs = spark.range(0, min(reach, every)).select(F.col("id").alias("k"), F.floor(turn / max(nodes, 1)).alias("src"), F.pmod(turn, F.lit(max(nodes, 1))).alias("dst"))
        free = pairs.filter("src < dst").join(known, ["src", "dst"], "left_anti")
        if reach >= every or free.count() >= wanted:
            return free.orderBy("k").limit(wanted).select("src", "dst")
        reach *= 4


def path_members(paths: DataFrame, column: str, sep: str = "/") -> DataFrame:
    """(parent, member) of every step of a path."""
    parts = F.split(column, sep)
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), sep).alias("parent"), F.array_join(F.slice(parts, 1, k + 1), sep).alias("member")))
    return paths.filter(F.size(parts) > 1).select(F.explode(steps).alias("x")).select("x.parent", "x.member").distinct()


def hierarchical_names(edges: DataFrame) -> DataFrame:
    """(node, idx): position path like 1-0-2 of every node of trees (parent, node, child_idx), level by level to the last."""
    level = stage_table(edges.filter("parent is null").select("node", F.col("child_idx").cast("string").alias("idx")), "level")
    out = level
    while not level.isEmpty():
        step = edges.join(level.select(F.col("node").alias("parent"), "idx"), "parent").select("node", F.concat_ws("-", "idx", F.col("child_idx").cast("string")).alias("idx"))
        level = stage_table(step, "level")
        out = out.union(level)
    return out


def queries() -> dict:
    def sub(s, d):
        p = table(s, d, "part").select(F.col("p_partkey").alias("k")).filter("k > 0")
        cyc = s.createDataFrame([("c0", "c1"), ("c1", "c0"), ("c1", "c2")], "src string, dst string")
        return p.select(F.concat(F.lit("p"), "k").alias("src"), F.concat(F.lit("p"), F.floor(F.col("k") / 3)).alias("dst")).union(cyc)

    def chains(s, d):
        return table(s, d, "part").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 7).alias("dst"))

    def line_edges(s, d):
        return followed_by(table(s, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"], F.concat_ws("_", "l_orderkey", "l_linenumber", "l_partkey")).select("src", "dst").distinct()

    def graph_sizes(s, d):
        return table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg((F.count_distinct("l_partkey") + 1).alias("size"))

    def splits(s, d):
        e = table(s, d, "orders").select(F.col("o_orderkey").alias("k"))
        return e.select("k", hash_split(F.col("k"), 10, 5).alias("part"))

    def negatives(s, d):
        return negative_edges(table(s, d, "orders").select(F.col("o_custkey").alias("src"), F.pmod(F.col("o_orderkey") * 7, F.lit(1009)).alias("dst")))

    def tree(s, d):
        # heap order: the children of k are 3k - 1 to 3k + 1
        p = table(s, d, "part").select(F.col("p_partkey").alias("node"))
        return p.select("node", F.when(F.col("node") > 1, F.floor((F.col("node") + 1) / 3)).alias("parent"), F.when(F.col("node") > 1, F.pmod(F.col("node") + 1, F.lit(3))).otherwise(F.lit(0)).cast("int").alias("child_idx"))

    def repo_paths(s, d):
        return path_members(table(s, d, "repo").filter("code_path is not null").select("code_path"), "code_path")

    return {
        "subclass_closure": lambda s, d: closure(sub(s, d)).select("src", "dst"),
        "components_min_label": lambda s, d: components(chains(s, d)),
        "ask_supertopic": lambda s, d: _ask(s, d, sub),
        "followed_by_edges": line_edges,
        "root_nodes": lambda s, d: roots(chains(s, d)),
        "supernode_edges": lambda s, d: with_supernode(table(s, d, "lineitem").select(F.col("l_orderkey").alias("graph_id"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()),
        "supernode_offsets": lambda s, d: block_offsets(graph_sizes(s, d)),
        "graph_masks": lambda s, d: masks(block_offsets(graph_sizes(s, d))),
        "edge_split_stats": splits,
        "negative_edges": negatives,
        "undirected_edges": lambda s, d: undirected(table(s, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))),
        "path_hierarchy_members": repo_paths,
        "hierarchical_names": lambda s, d: hierarchical_names(tree(s, d)),
        "graph_union": lambda s, d: chains(s, d).union(chains(s, d)).union(table(s, d, "part").select(F.col("p_partkey"), F.col("p_partkey") + 7)).distinct(),
    }


def _ask(s, d, sub):
    from knotwork.operators.closure import reachable

    e = sub(s, d)
    return reachable(e, "p100", "p0").unionByName(reachable(e, "c2", "c0")).unionByName(reachable(e, "c1", "c1")).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


def oracle_sql() -> dict[str, str]:
    sub = "e AS (SELECT 'p' || p_partkey AS src, 'p' || CAST(p_partkey // 3 AS BIGINT) AS dst FROM part WHERE p_partkey > 0 UNION ALL VALUES ('c0', 'c1'), ('c1', 'c0'), ('c1', 'c2'))"
    chains = "e AS (SELECT p_partkey AS src, p_partkey + 7 AS dst FROM part WHERE p_size % 2 = 0)"
    sizes = "g AS (SELECT l_orderkey AS graph_id, CAST(count(DISTINCT l_partkey) + 1 AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey), o AS (SELECT graph_id, size, CAST(sum(size) OVER (ORDER BY graph_id) - size AS BIGINT) AS first, CAST(sum(size) OVER (ORDER BY graph_id) - 1 AS BIGINT) AS supernode FROM g)"
    return {
        "subclass_closure": f"WITH RECURSIVE {sub}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT src, dst FROM r",
        "components_min_label": f"WITH RECURSIVE {chains}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (SELECT src AS node, src AS seen FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON r.seen = b.src) SELECT node, min(seen) AS component FROM r GROUP BY node",
        "ask_supertopic": f"WITH RECURSIVE {sub}, w AS (SELECT * FROM (VALUES ('p100', 'p0'), ('c2', 'c0'), ('c1', 'c1')) t(a, b)), r AS (SELECT a, a AS node FROM w UNION SELECT r.a, e.dst FROM r JOIN e ON r.node = e.src) SELECT answer, count(*) AS n FROM (SELECT EXISTS (SELECT 1 FROM r WHERE r.a = w.a AND r.node = w.b) AS answer FROM w) GROUP BY answer",
        "followed_by_edges": "SELECT DISTINCT src, dst FROM (SELECT lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS src, c AS dst FROM (SELECT *, l_orderkey || '_' || l_linenumber || '_' || l_partkey AS c FROM lineitem)) WHERE src IS NOT NULL",
        "root_nodes": f"WITH {chains} SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)",
        "supernode_edges": "WITH e AS (SELECT DISTINCT l_orderkey AS g, 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), n AS (SELECT g, src AS node FROM e UNION SELECT g, dst FROM e) SELECT g AS graph_id, src, dst FROM e UNION ALL SELECT g, 'supernode', node FROM n",
        "supernode_offsets": f"WITH {sizes} SELECT * FROM o",
        "graph_masks": f"WITH {sizes}, k AS (SELECT *, row_number() OVER (ORDER BY graph_id) AS k, count(*) OVER () AS n FROM o), c AS (SELECT max(CASE WHEN k = CAST(ceil(n * 0.8) AS BIGINT) THEN supernode END) AS t, max(CASE WHEN k = n THEN supernode END) AS v FROM k) SELECT graph_id, first, supernode, CAST(greatest(0, least(first + size, t - 1) - greatest(first, 0)) AS BIGINT) AS n_train, CAST(greatest(0, least(first + size, v - 1) - greatest(first, t)) AS BIGINT) AS n_val FROM o, c",
        "edge_split_stats": "SELECT k, CASE WHEN t < 10 THEN 'test' WHEN t < 15 THEN 'valid' ELSE 'train' END AS part FROM (SELECT o_orderkey AS k, (o_orderkey * 7919 + 104729) % 100 AS t FROM orders)",
        "negative_edges": "WITH e AS (SELECT o_custkey AS a, (o_orderkey * 7) % 1009 AS b FROM orders), u AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM e WHERE a <> b), c AS (SELECT max(dst) + 1 AS nodes, count(*) // 10 AS wanted FROM u), p AS (SELECT i AS k, ((i * 2147483647) % (nodes * nodes)) // nodes AS src, ((i * 2147483647) % (nodes * nodes)) % nodes AS dst FROM c, range(0, 200000) t(i) WHERE i < nodes * nodes), q AS (SELECT *, row_number() OVER (ORDER BY k) AS rn FROM p WHERE src < dst AND NOT EXISTS (SELECT 1 FROM u WHERE u.src = p.src AND u.dst = p.dst)) SELECT src, dst FROM q, c WHERE rn <= wanted",
        "undirected_edges": "SELECT DISTINCT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst FROM lineitem WHERE l_partkey <> l_suppkey",
        "path_hierarchy_members": "SELECT DISTINCT array_to_string(p[1:k], '/') AS parent, array_to_string(p[1:k + 1], '/') AS member FROM (SELECT p, unnest(range(1, len(p))) AS k FROM (SELECT string_split(code_path, '/') AS p FROM repo WHERE code_path IS NOT NULL))",
        "hierarchical_names": "WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN (p_partkey + 1) // 3 END AS parent, CASE WHEN p_partkey > 1 THEN (p_partkey + 1) % 3 ELSE 0 END AS k FROM part), r AS (SELECT node, CAST(k AS VARCHAR) AS idx FROM t WHERE parent IS NULL UNION ALL SELECT t.node, r.idx || '-' || t.k FROM t JOIN r ON t.parent = r.node) SELECT node, idx FROM r",
        "graph_union": "SELECT p_partkey AS src, p_partkey + 7 AS dst FROM part",
    }
