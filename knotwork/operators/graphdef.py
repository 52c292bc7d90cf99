"""Computation graphs in nested JSON as triples: node hierarchy, attribute rules, simplification."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import stage_table, table

# Attribute path to predicate, where they differ; other attributes of ATTRIBUTES are their own predicate.
RENAMED = {"T": "T_type", "Tdim": "Tdim_dtype", "Tshape": "Tshape_dtype", "keep_dims": "Keep_dims"}
ATTRIBUTES = frozenset(
    "T transpose_a transpose_b dtype Tdim Tidx Tshape N keep_dims validate_indices summarize out_type index_type data_format use_locking use_nesterov shared_name container "
    "set_operation seed2 seed DstT SrcT Truncate output_type validate_shape Index axis begin_mask end_mask new_axis_mask Tmultiples Tlabels shrink_axis_mask message ellipsis_mask "
    "padding TI use_cudnn_on_gpu depth_radius alpha beta bias Tperm identical_element_shapes clear_after_read".split()
)
SHAPES = {"shape": "shape", "_output_shapes": "output_shape"}


def attribute_triples(name: str, attr: dict) -> Iterator[tuple[str, str, str]]:
    """(node, predicate, value) of the attributes of one node; shapes are joined by commas, of lists only two."""
    for key, value in attr.items():
        value = value or {}
        if key in ATTRIBUTES:
            leaf = next(iter(value.values()), None)
            if not isinstance(leaf, (dict, list)) and leaf is not None:
                yield name, RENAMED.get(key, key), str(leaf)
        elif key in SHAPES:
            shapes = [value["shape"]] if "shape" in value else (value.get("list") or {}).get("shape", [])
            for k, s in enumerate(shapes[:2]):
                dims = ",".join(str(x.get("size")) for x in (s or {}).get("dim", []))
                yield name, SHAPES[key] + ("2" if k else ""), dims or "scalar"
        elif key == "value" and "tensor" in value:
            t = value["tensor"]
            dims = ",".join(str(x.get("size")) for x in (t.get("tensorShape") or {}).get("dim", []))
            if "tensorShape" in t:
                yield name, "tensor_shape", dims or "scalar"
            for a, p in (("dtype", "tensor_dtype"), ("tensorContent", "tensor_content")):
                if a in t:
                    yield name, p, str(t[a])


def graph_triples(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of one graph: operation, device, inputs, hierarchy of path names, attributes."""
    for node in json.loads(text).get("node", []):
        name = node["name"]
        yield name, "op", node.get("op", "")
        if node.get("device"):
            yield name, "device", node["device"]
        for i in node.get("input", []):
            yield i.lstrip("^").split(":")[0], "feeds", name
        parts = name.split("/")
        for k in range(1, len(parts)):
            yield "/".join(parts[:k]), "hasMember", "/".join(parts[: k + 1])
        yield from attribute_triples(name, node.get("attr") or {})


def triples(graphs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, s, p, o) of graphs in JSON, each triple once; text that is no JSON gives none."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(k, *x) for x in graph_triples(t)]
                except (ValueError, KeyError, AttributeError, TypeError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.column(0).type), *(pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3))], ["k", "s", "p", "o"])

    kind = dict(graphs.dtypes)[key]
    rows = graphs.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(task, f"k {kind}, s string, p string, o string")
    return rows.distinct().withColumnRenamed("k", key)


def simplified(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges between kept ancestors: each end goes to its longest kept path prefix; loops and ends without one go."""
    def lift(df: DataFrame, c: str) -> DataFrame:
        parts = F.split(c, "/")
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
        each = df.select(c).distinct().select(c, F.explode(prefixes).alias("name")).join(kept.select("name"), "name", "left_semi")
        best = each.groupBy(c).agg(F.max_by("name", F.length("name")).alias(f"_{c}"))
        return df.join(best, c)

    out = lift(lift(edges.select("src", "dst"), "src"), "dst")
    return out.filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def is_member(name: Column, group: Column) -> Column:
    """Whether a path lies in a group: equal to it or below it; a leading ``^`` of control inputs counts for nothing."""
    plain = F.regexp_replace(name, r"^\^", "")
    return (plain == group) | F.startswith(plain, F.concat(group, F.lit("/")))


def walk(edges: DataFrame, starts: DataFrame, stops: list[str]) -> DataFrame:
    """(node, depth): nodes reached from the starts, breadth first; nodes whose name holds a stop word are neither entered nor passed.

    Each round joins the frontier with the edges and is written to the shared folder.
    """
    barred = lambda c: F.exists(F.array(*map(F.lit, stops)), lambda w: F.contains(F.lower(c), w)) if stops else F.lit(False)
    edges = stage_table(edges.select("src", "dst").filter(~barred(F.col("dst"))).distinct(), "edges")
    seen = front = stage_table(starts.select("node", F.lit(0).alias("depth")).filter(~barred(F.col("node"))).distinct(), "front")
    depth = 0
    while not front.isEmpty():
        depth += 1
        step = front.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = stage_table(step.withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
    return seen


def of_interest(nodes: DataFrame, words: list[str]) -> DataFrame:
    """Nodes whose name holds one of the words."""
    return nodes.filter(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("node"), w)))


def latest_files(paths: DataFrame) -> DataFrame:
    """(folder, path): of the files ``graph_N.json`` of each folder the one with the largest N."""
    n = F.regexp_extract("path", r"/graph_(\d+)\.json$", 1)
    rows = paths.filter(n != "").select(F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), n.cast("long").alias("n"), "path")
    return rows.groupBy("folder").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


# Parts of the API that give no classes.
NO_CLASSES = ("tf.logging", "tf.io", "tf.strings", "tf.gfile")


def subclass_triples(names: DataFrame) -> DataFrame:
    """(s, p, o): every dotted name below another is its subclass; names of ``NO_CLASSES`` and below are left out."""
    steps = api_vocabulary(names)
    for x in NO_CLASSES:
        steps = steps.filter(~is_member(F.replace("child", F.lit("."), F.lit("/")), F.lit(x.replace(".", "/"))))
    return steps.select(F.col("child").alias("s"), F.lit("subClassOf").alias("p"), F.col("parent").alias("o"))


def api_vocabulary(trees: DataFrame) -> DataFrame:
    """(parent, child) of an API tree whose nodes are dotted names, for subclass triples."""
    parts = F.split("name", r"\.")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), ".").alias("parent"), F.array_join(F.slice(parts, 1, k + 1), ".").alias("child")))
    return trees.filter(F.size(parts) > 1).select(F.explode(steps).alias("x")).select("x.parent", "x.child").distinct()


def _graphs(s, d) -> DataFrame:
    """A computation graph in JSON per brand: the parts are nodes below their size, each fed by the next lower one of its size."""
    name = lambda k: F.concat_ws("/", F.lower("p_brand"), F.concat(F.lit("s"), "p_size"), F.concat(F.lit("n"), k.cast("string")))
    w = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    p = table(s, d, "part").select("p_brand", "p_partkey", "p_size", "p_type", F.lag("p_partkey").over(w).alias("before"))
    dim = F.struct(F.array(F.struct(F.col("p_size").cast("string").alias("size")), F.struct(F.lit("3").alias("size"))).alias("dim"))
    attr = F.struct(F.struct(F.col("p_type").alias("type")).alias("T"), F.struct(F.col("p_size").cast("string").alias("i")).alias("N"), F.struct(dim.alias("shape")).alias("shape"))
    node = F.struct(name(F.col("p_partkey")).alias("name"), F.upper("p_type").alias("op"), F.when(F.col("before").isNotNull(), F.array(F.concat(F.lit("^"), name(F.col("before"))))).otherwise(F.array().cast("array<string>")).alias("input"), attr.alias("attr"))
    return p.select("p_brand", node.alias("n")).groupBy("p_brand").agg(F.to_json(F.struct(F.sort_array(F.collect_list("n")).alias("node"))).alias("text"))


def queries() -> dict:
    def calls(s, d):
        return table(s, d, "part").select(F.concat_ws("_", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("n"), "p_partkey")

    def edges(s, d):
        n = calls(s, d)
        child = n.select(F.col("n").alias("dst"), F.floor((F.col("p_partkey") + 1) / 3).alias("k"))
        return child.join(n.select(F.col("n").alias("src"), F.col("p_partkey").alias("k")), "k").select("src", "dst")

    def paths(s, d):
        path = lambda k: F.concat_ws("/", F.lower("p_brand"), F.concat(F.lit("s"), "p_size"), F.concat(F.lit("n"), k.cast("string")))
        p = table(s, d, "part").select(F.col("p_partkey").alias("k"), path(F.col("p_partkey")).alias("src"))
        return p.join(p.select((F.col("k") - 1).alias("k"), F.col("src").alias("dst")), "k").select("src", "dst")

    def kept(s, d):
        p = table(s, d, "part")
        return p.select(F.lower("p_brand").alias("name")).union(p.filter("p_size % 2 = 0").select(F.concat_ws("/", F.lower("p_brand"), F.concat(F.lit("s"), "p_size")))).distinct()

    def names(s, d):
        word = lambda k: F.element_at(F.split("p_name", " "), k)
        top = F.element_at(F.array(*map(F.lit, ("nn", "io", "layers"))), F.pmod("p_partkey", F.lit(3)).cast("int") + 1)
        return table(s, d, "part").select(F.concat_ws(".", F.lit("tf"), top, word(1), word(-1)).alias("name"))

    return {
        "computation_graph_triples": lambda s, d: triples(_graphs(s, d), "p_brand", "text"),
        "simplified_edges": lambda s, d: simplified(paths(s, d), kept(s, d)),
        "group_members": lambda s, d: paths(s, d).join(F.broadcast(s.createDataFrame([("brand#11",), ("brand#1",), ("brand#23/s7",)], "name string")), is_member(F.concat(F.lit("^"), "src"), F.col("name"))).select("name", "src"),
        "walk_with_stops": lambda s, d: walk(edges(s, d), calls(s, d).filter("p_partkey <= 9").select(F.col("n").alias("node")), ["red", "small"]),
        "nodes_of_interest": lambda s, d: of_interest(walk(edges(s, d), calls(s, d).filter("p_partkey <= 9").select(F.col("n").alias("node")), ["red", "small"]), ["ring", "blue"]),
        "latest_graph_files": lambda s, d: latest_files(table(s, d, "orders").select(F.concat(F.lit("/runs/"), "o_custkey", F.lit("/graph_"), "o_orderkey", F.lit(".json")).alias("path"))),
        "api_subclasses": lambda s, d: subclass_triples(names(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    base = "WITH RECURSIVE n AS (SELECT p_brand, lower(p_brand) || '/s' || p_size || '/n' || p_partkey AS name, lower(p_brand) AS a, lower(p_brand) || '/s' || p_size AS b, p_type, p_size, lag(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS before, p_partkey FROM part)"
    tree = "WITH RECURSIVE n AS (SELECT p_partkey AS k, p_partkey || '_' || replace(p_name, ' ', '_') AS n FROM part), r AS (SELECT k, n, 0 AS depth FROM n WHERE k <= 9 AND NOT regexp_matches(n, 'red|small') UNION ALL SELECT n.k, n.n, r.depth + 1 FROM n JOIN r ON (n.k + 1) // 3 = r.k AND n.k > 1 WHERE NOT regexp_matches(n.n, 'red|small'))"
    return {
        "computation_graph_triples": f"{base} SELECT p_brand, name AS s, 'op' AS p, upper(p_type) AS o FROM n UNION SELECT p_brand, b || '/n' || before, 'feeds', name FROM n WHERE before IS NOT NULL UNION SELECT p_brand, a, 'hasMember', b FROM n UNION SELECT p_brand, b, 'hasMember', name FROM n UNION SELECT p_brand, name, 'T_type', p_type FROM n UNION SELECT p_brand, name, 'N', CAST(p_size AS VARCHAR) FROM n UNION SELECT p_brand, name, 'shape', p_size || ',3' FROM n",
        "simplified_edges": "WITH p AS (SELECT p_partkey AS k, lower(p_brand) AS a, lower(p_brand) || '/s' || p_size AS b, p_size % 2 = 0 AS even FROM part), q AS (SELECT x.k, CASE WHEN x.even THEN x.b ELSE x.a END AS src, CASE WHEN y.even THEN y.b ELSE y.a END AS dst FROM p x JOIN p y ON y.k = x.k + 1) SELECT DISTINCT src, dst FROM q WHERE src <> dst",
        "group_members": f"{base} SELECT 'brand#11' AS name, name AS src FROM n WHERE a = 'brand#11' UNION ALL SELECT 'brand#1', name FROM n WHERE a = 'brand#1' UNION ALL SELECT 'brand#23/s7', name FROM n WHERE b = 'brand#23/s7'",
        "walk_with_stops": f"{tree} SELECT n AS node, min(depth) AS depth FROM r GROUP BY n",
        "nodes_of_interest": f"{tree} SELECT n AS node, min(depth) AS depth FROM r WHERE regexp_matches(n, 'ring|blue') GROUP BY n",
        "latest_graph_files": "SELECT '/runs/' || o_custkey AS folder, '/runs/' || o_custkey || '/graph_' || max(o_orderkey) || '.json' AS path FROM orders GROUP BY o_custkey",
        "api_subclasses": "WITH n AS (SELECT ['nn', 'io', 'layers'][p_partkey % 3 + 1] AS t, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', -1) AS b FROM part) SELECT DISTINCT 'tf.' || t AS s, 'subClassOf' AS p, 'tf' AS o FROM n WHERE t <> 'io' UNION SELECT DISTINCT 'tf.' || t || '.' || a, 'subClassOf', 'tf.' || t FROM n WHERE t <> 'io' UNION SELECT DISTINCT 'tf.' || t || '.' || a || '.' || b, 'subClassOf', 'tf.' || t || '.' || a FROM n WHERE t <> 'io'",
    }
