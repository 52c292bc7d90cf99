"""Writers of triples, vocabularies and drawings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _node(value: Column, kind: Column) -> Column:
    text = F.concat(F.lit('"'), F.replace(F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit('"'))
    return F.when(kind == "uri", F.concat(F.lit("<"), value, F.lit(">"))).when(kind == "bnode", value).otherwise(text)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One N-Triples line per triple."""
    suffix = F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(F.lit(""))
    return triples.select(F.concat(_node(F.col("s"), F.col("s_kind")), F.lit(" <"), "p", F.lit("> "), _node(F.col("o"), F.col("o_kind")), F.when(F.col("o_kind") == "literal", suffix).otherwise(F.lit("")), F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.mode("overwrite").text(path)


def write_triple_files(triples: DataFrame, path: str, by: str, sep: str = "\t") -> None:
    """A folder of triple lines per value of ``by``; line ends, tabs and runs of four blanks in terms are taken out."""
    clean = lambda c: F.regexp_replace(c, r"[\n\t]|    ", "")
    triples.select(by, F.concat_ws(sep, *(clean(F.col(c)) for c in ("s", "p", "o"))).alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def write_sorted(df: DataFrame, column: str, path: str) -> None:
    """Distinct values in order, as text files whose names keep the order."""
    df.select(F.col(column).cast("string").alias("value")).filter("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_vertical(triples: DataFrame, path: str) -> None:
    """Triples partitioned by graph and predicate, so a pattern reads only its predicate's files."""
    triples.repartition("graph", "p").write.mode("overwrite").partitionBy("graph", "p").parquet(path)


def dot_lines(edges: DataFrame, label: str | None = None) -> DataFrame:
    """Lines of a drawing in DOT, without its frame."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(c, r"[.\-/]", "__"), r"^(?i:digraph|graph|cluster|subgraph|node|edge)$", "$0X")
    tail = F.concat(F.lit(' [label="'), F.col(label), F.lit('"]')) if label else F.lit("")
    return edges.select(F.concat(F.lit('    "'), safe(F.col("src")), F.lit('" -> "'), safe(F.col("dst")), F.lit('"'), tail, F.lit(";")).alias("value"))


def tgf_lines(edges: DataFrame) -> DataFrame:
    """Node lines, a ``#`` and edge lines of the trivial graph format, in that order by ``part``."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().select(F.lit(0).alias("part"), F.concat_ws(" ", "n", "n").alias("value"))
    lines = edges.select(F.lit(2).alias("part"), F.concat_ws(" ", "src", "dst").alias("value")).distinct()
    return nodes.union(edges.sparkSession.createDataFrame([(1, "#")], "part int, value string")).union(lines).orderBy("part", "value")


def graphml_lines(edges: DataFrame) -> DataFrame:
    """Node and edge elements of a GraphML document."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().select(F.lit(0).alias("part"), F.concat(F.lit('<node id="'), esc(F.col("n")), F.lit('"/>')).alias("value"))
    lines = edges.distinct().select(F.lit(1).alias("part"), F.concat(F.lit('<edge source="'), esc(F.col("src")), F.lit('" target="'), esc(F.col("dst")), F.lit('"/>')).alias("value"))
    return nodes.union(lines)


def turtle_lines(triples: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """Turtle: a line per prefix, then one block per subject with its predicates in order, as rows (part, value) in that order."""
    short = lambda c: _prefixed(c, prefixes)
    suffix = F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise(F.lit(""))
    term = lambda c, kind: F.when(kind == "uri", short(c)).otherwise(_node(c, kind))
    o = F.concat(term(F.col("o"), F.col("o_kind")), F.when(F.col("o_kind") == "literal", suffix).otherwise(F.lit("")))
    p = F.when(F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", F.lit("a")).otherwise(short(F.col("p")))
    each = triples.select(term(F.col("s"), F.col("s_kind")).alias("s"), p.alias("p"), o.alias("o")).distinct().groupBy("s", "p").agg(F.array_join(F.sort_array(F.collect_list("o")), ", ").alias("o"))
    block = each.groupBy("s").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "o"))), lambda x: F.concat(x["p"], F.lit(" "), x["o"])), " ;\n    ").alias("b"))
    head = triples.sparkSession.createDataFrame([(0, f"@prefix {k}: <{v}> .") for k, v in sorted(prefixes.items())], "part int, value string")
    return head.unionByName(block.select(F.lit(1).alias("part"), F.concat("s", F.lit(" "), "b", F.lit(" .")).alias("value"))).orderBy("part", "value")


def _prefixed(c: Column, prefixes: dict[str, str]) -> Column:
    out = F.concat(F.lit("<"), c, F.lit(">"))
    for k, v in prefixes.items():
        rest = F.substring(c, F.lit(len(v) + 1), F.length(c))
        out = F.when(F.startswith(c, F.lit(v)) & F.rlike(rest, F.lit(r"^[A-Za-z_][\w-]*$")), F.concat(F.lit(f"{k}:"), rest)).otherwise(out)
    return out


def write_turtle(triples: DataFrame, prefixes: dict[str, str], path: str) -> None:
    """Turtle files in order; only the first begins with the prefixes, so they are to be read as one document."""
    turtle_lines(triples, prefixes).select("value").write.mode("overwrite").text(path)


def write_quads(quads: DataFrame, path: str, by: str = "root") -> None:
    """A folder of tab-separated quads (s, p, o, idx) per root; line ends, tabs and runs of four blanks in terms are taken out."""
    clean = lambda c: F.regexp_replace(c, r"[\n\t]|    ", "")
    quads.select(by, F.concat_ws("\t", *(clean(F.col(c)) for c in ("s", "p", "o")), "idx").alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def append_numbered(rows: DataFrame, known: DataFrame | None, key: str) -> DataFrame:
    """New rows (by key) numbered on from the largest number of the known table (key, number), in the order of the key."""
    from knotwork.operators.sampling import numbered

    first = 0 if known is None else (known.agg(F.max("number")).first()[0] or 0) + (0 if known.isEmpty() else 1)
    new = rows if known is None else rows.join(known.select(key), key, "left_anti")
    return numbered(new.dropDuplicates([key]), [key], "number").withColumn("number", F.col("number") + first)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with their labels as Parquet: key, vector as an array of doubles, label columns."""
    vectors.write.mode("overwrite").parquet(path)


def html_drawing(edges: DataFrame, most: int = 10_000) -> str:
    """A page with a table of at most ``most`` + 1 edges of a drawing, in order."""
    from html import escape

    rows = edges.orderBy(*edges.columns).limit(most + 1).collect()
    return "<table>\n" + "\n".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows) + "\n</table>\n"
