"""Models of drawings: labelled edges of graphs and grouped call graphs, as tables that any drawing can take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.analytics import publication_graph
from knotwork.session import table


def chosen_edges(triples: DataFrame, predicates: list[str], show: bool = True) -> DataFrame:
    """Triples of the given predicates, or of all others; all where none is given."""
    if not predicates:
        return triples
    inside = F.col("p").isin(*predicates)
    return triples.filter(inside if show else ~inside)


def first_edges(edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` + 1 edges in order; a drawing stops after the edge that reaches its bound."""
    return edges.orderBy("s", "p", "o").limit(most + 1)


def _local(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def labelled_edges(triples: DataFrame, predicates: list[str], show: bool = True, text: str = "hasText", kind: str = "type") -> DataFrame:
    """(s, p, o, s_type, o_type, s_label, o_label) of all edges but texts.

    A node's label is its text, else the last part of its name; its type the least one that it has, else ``Literal``;
    classes of an API (``tf/``) are one type, and their nodes are labelled with the class.
    """
    texts = triples.filter(F.col("p") == text).groupBy("s").agg(F.min("o").alias("text"))
    types = triples.filter(F.col("p") == kind).groupBy("s").agg(F.min("o").alias("type"))
    nodes = types.join(texts, "s", "full").select(F.col("s").alias("node"), "type", "text")
    out = chosen_edges(triples.filter(F.col("p") != text), predicates, show)
    for end in ("s", "o"):
        side = nodes.select(F.col("node").alias(end), F.col("type").alias(f"_{end}"), F.col("text").alias(f"_{end}t"))
        api = F.startswith(f"_{end}", F.lit("tf/"))
        out = out.join(side, end, "left").withColumns(
            {
                f"{end}_type": F.when(api, "tf").otherwise(F.coalesce(f"_{end}", F.lit("Literal"))),
                f"{end}_label": F.when(api, _local(F.col(f"_{end}"))).otherwise(F.coalesce(f"_{end}t", _local(F.col(end)))),
            }
        )
    return out.select("s", "p", "o", "s_type", "o_type", "s_label", "o_label")


def grouped_nodes(nodes: DataFrame) -> DataFrame:
    """(name, label, namespace, level) of the defined nodes (name, defined) of a call graph with dotted names.

    The label is the last part of a name, the namespace what stands before it, the level the number of its parts.
    """
    parts = F.split("name", r"\.")
    return nodes.filter("defined").select("name", F.element_at(parts, -1).alias("label"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".").alias("namespace"), (F.size(parts) - 1).alias("level")).distinct()


def nested_groups(nodes: DataFrame) -> DataFrame:
    """(namespace, within, nodes): every namespace and those above it, with the next one above and the nodes right in it."""
    own = nodes.filter("namespace <> ''").groupBy("namespace").agg(F.count(F.lit(1)).alias("nodes"))
    parts = F.split("namespace", r"\.")
    all_ = nodes.filter("namespace <> ''").select("namespace").distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("namespace")).distinct()
    up = F.regexp_extract("namespace", r"^(.*)\.[^.]*$", 1)
    return all_.join(own, "namespace", "left").select("namespace", F.nullif(up, F.lit("")).alias("within"), F.coalesce("nodes", F.lit(0)).alias("nodes"))


def queries() -> dict:
    def names(s, d):
        word = lambda k: F.element_at(F.split("p_name", " "), k)
        return table(s, d, "part").select(F.concat_ws(".", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), word(1), F.concat(word(-1), F.pmod("p_partkey", F.lit(5)).cast("string"))).alias("name"), (F.col("p_size") % 3 > 0).alias("defined"))

    return {
        "labelled_edges": lambda s, d: labelled_edges(publication_graph(s, d).triples(), ["hasEntity", "hasFunction", "partOf"]),
        "hidden_edges": lambda s, d: chosen_edges(publication_graph(s, d).triples(), ["hasEntity", "hasFunction", "type", "hasText", "hasCSOEquivalent", "partOf", "hasFigure"], show=False),
        "first_edges": lambda s, d: first_edges(publication_graph(s, d).triples("hasRepository"), 25),
        "grouped_nodes": lambda s, d: grouped_nodes(names(s, d)),
        "nested_groups": lambda s, d: nested_groups(grouped_nodes(names(s, d))),
    }


def oracle_sql() -> dict[str, str]:
    from knotwork.operators.analytics import _CTE

    names = "WITH n AS (SELECT DISTINCT lower(replace(p_brand, '#', '_')) || '.' || split_part(p_name, ' ', 1) AS ns, split_part(p_name, ' ', -1) || p_partkey % 5 AS label FROM part WHERE p_size % 3 > 0)"
    return {
        "labelled_edges": f"""{_CTE} SELECT s, 'hasEntity' AS p, e AS o, 'Publication' AS s_type, type AS o_type, replace(s, 'pub/', '') AS s_label, txt AS o_label FROM ent
          UNION ALL SELECT repository, 'hasFunction', f, 'Literal', CASE WHEN starts_with(t, 'tf/') THEN 'tf' ELSE t END, replace(repository, 'repo/', ''), CASE WHEN starts_with(t, 'tf/') THEN split_part(t, '/', -1) ELSE replace(f, 'fn/', '') END FROM (SELECT repository, f FROM fn GROUP BY 1, 2) JOIN (SELECT f, min(type) AS t FROM fn GROUP BY 1) USING (f)
          UNION ALL SELECT c, 'partOf', replace(s, 'pub/', 'fig/'), 'Literal', 'Literal', replace(c, 'comp/', ''), replace(s, 'pub/', '') FROM (SELECT DISTINCT c, s FROM comp)""",
        "hidden_edges": f"{_CTE} SELECT s, 'conferenceSeries' AS p, conference AS o FROM pub UNION ALL SELECT s, 'yearOfPublication', CAST(year AS VARCHAR) FROM pub UNION ALL SELECT s, 'platform', platform FROM pub UNION ALL SELECT s, 'hasRepository', repository FROM pub",
        "first_edges": f"{_CTE} SELECT s, 'hasRepository' AS p, repository AS o FROM pub ORDER BY s, o LIMIT 26",
        "grouped_nodes": f"{names} SELECT ns || '.' || label AS name, label, ns AS namespace, 2 AS level FROM n",
        "nested_groups": f"{names} SELECT ns AS namespace, split_part(ns, '.', 1) AS within, count(*) AS nodes FROM n GROUP BY ns UNION ALL SELECT DISTINCT split_part(ns, '.', 1), NULL, 0 FROM n",
    }
