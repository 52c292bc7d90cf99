"""Readers and writers as queries: rows of the tables go out to the shared folder in a format and are read back from there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.operators.construction import _trees, named_trees, tree_quads
from knotwork.session import shared_dir, table
from knotwork.sources import readers, writers

KG = "http://example.org/kg/"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, name: str, by: str | None = None) -> str:
    """Folder with the rows' ``value`` as text, a subfolder per value of ``by``; no row is parted from its file."""
    path = _folder(df.sparkSession, name)
    (df.repartition(by).write.partitionBy(by) if by else df.write).text(path)
    return path


def _triples(s, d) -> DataFrame:
    p = table(s, d, "part")
    node = F.concat(F.lit(KG + "part"), "p_partkey")
    uri = p.select(node.alias("s"), F.lit(KG + "brand").alias("p"), F.concat(F.lit(KG), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_")))).alias("o"), F.lit("uri").alias("o_kind"))
    text = p.select(node, F.lit(KG + "title"), F.concat(F.lit('the "'), "p_name", F.lit('"\t\\ part')), F.lit("literal"))
    null = F.lit(None).cast("string")
    return uri.union(text).select(F.lit("").alias("graph"), "s", F.lit("uri").alias("s_kind"), "p", "o", "o_kind", null.alias("o_datatype"), null.alias("o_lang"))


def queries() -> dict:
    def ntriples(s, d):
        path = _folder(s, "nt")
        writers.write_ntriples(_triples(s, d), path)
        return readers.ntriples(s, path).select("s", "p", "o", "o_kind")

    def turtle(s, d):
        # a Turtle document is one file; the prefixes stand at its begin
        path = _folder(s, "ttl")
        writers.turtle_lines(_triples(s, d), {"kg": KG}).select("value").coalesce(1).write.text(path)
        return readers.turtle(s, path).select("s", "p", "o", "o_kind")

    def triple_files(s, d):
        path = _folder(s, "triples")
        t = table(s, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("paper"), F.concat(F.lit("a\tb"), "n_name").alias("s"), F.lit("in").alias("p"), F.col("n_regionkey").cast("string").alias("o"))
        writers.write_triple_files(t, path, "paper")
        return readers.triple_lines(s, f"{path}/*/*.txt")

    def quads(s, d):
        path = _folder(s, "quads")
        trees = named_trees(_trees(s, d))
        writers.write_quads(tree_quads(trees).withColumn("root", F.lit("all")), path)
        f = F.split("value", "\t")
        return s.read.text(f"{path}/*/*.txt").select(f[0].alias("s"), f[1].alias("p"), f[2].alias("o"), f[3].alias("idx"))

    def labels(s, d):
        rows = table(s, d, "part").select(F.concat(F.lit("﻿head,x\n"), F.array_join(F.array(F.concat(F.lit('"'), "p_name", F.lit(', part",')), F.concat(F.lit(""), "p_partkey")), "")).alias("value"))
        return readers.label_map(s, _text(rows, "labels")).filter("key not like '%head'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))

    def positions(s, d):
        rows = table(s, d, "supplier").select(F.concat_ws(";", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), "s_name", F.lit('; ""x"""')), F.col("s_nationkey").cast("string")).alias("value"))
        return readers.positional_csv(s, _text(rows, "positions"), ";", 0).select(F.col("fields")[0].alias("k"), F.col("fields")[1].alias("name"), F.col("fields")[2].alias("nation"))

    def standoff(s, d):
        # one document per line number, an annotation and a relation per order in it
        rows = table(s, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
        lines = F.array(F.concat_ws("\t", F.concat(F.lit("T"), "l_orderkey"), F.concat(F.lit("Method "), "l_orderkey", F.lit(" "), F.col("l_orderkey") + 4), F.concat(F.lit("word"), "l_orderkey")), F.concat(F.lit("R"), "l_orderkey", F.lit("\tUsed-for Arg1:T"), "l_orderkey", F.lit(" Arg2:T1")))
        path = _text(rows.select("l_linenumber", F.explode(lines).alias("value")), "ann", "l_linenumber")
        entities, relations = readers.standoff(s, f"{path}/*/*.txt")
        return relations.join(entities.select(F.col("id").alias("arg1"), "start", "end", "text").distinct(), "arg1").groupBy("rel", "arg1", "arg2", "start", "end", "text").agg(F.count(F.lit(1)).alias("n"))

    def owl(s, d):
        head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:k="http://k.example/">'
        node = F.concat(F.lit('<k:Part rdf:about="p'), "p_partkey", F.lit('"><k:of><k:Brand rdf:about="'), "p_brand", F.lit('"><k:size>'), "p_size", F.lit("</k:size></k:Brand></k:of></k:Part>"))
        docs = table(s, d, "part").groupBy("p_brand").agg(F.concat(F.lit(head), F.array_join(F.collect_list(node), ""), F.lit("</rdf:RDF>")).alias("value"))
        path = _text(docs.withColumn("b", F.regexp_replace("p_brand", r"\W", "")).select("b", "value"), "owl", "b")
        return readers.rdf_xml(s, f"{path}/*/*.txt")

    def tei(s, d):
        open_ = "<TEI><teiHeader><titleStmt><title>"
        doc = F.concat(F.lit(open_), "n_name", F.lit("</title></titleStmt></teiHeader><text><body><div><p>One <hi>two</hi> three.</p></div><figure><figDesc>shows "), "n_name", F.lit("</figDesc></figure><figure><head>Fig</head></figure></body></text></TEI>"))
        path = _text(table(s, d, "nation").select("n_nationkey", doc.alias("value")), "tei", "n_nationkey")
        return readers.tei(s, f"{path}/*/*.txt").select("title", "text", F.explode("figures").alias("f")).select("title", "text", "f.head", "f.caption")

    def contexts(s, d):
        rows = table(s, d, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string"), F.lit(" a,b^c,d x,y z,"), F.col("s_nationkey").cast("string"), F.lit(",w")).alias("value"))
        return readers.path_context_lines(s, _text(rows, "contexts"))

    def numbers(s, d):
        p = table(s, d, "paper").filter("stored_dir_name is not null").select("stored_dir_name", "batch_no")
        known = writers.append_numbered(p.filter("batch_no = 0").select("stored_dir_name"), None, "stored_dir_name")
        return writers.append_numbered(p.filter("batch_no > 0").select("stored_dir_name"), known, "stored_dir_name").select("stored_dir_name", "number")

    return {
        "ntriples_round_trip": ntriples, "turtle_round_trip": turtle, "triple_file_round_trip": triple_files, "quad_file_round_trip": quads, "label_file": labels, "positional_file": positions,
        "standoff_file": standoff, "owl_file": owl, "tei_file": tei, "context_file": contexts, "appended_numbers": numbers,
    }


def oracle_sql() -> dict[str, str]:
    from knotwork.operators.construction import oracle_sql as built

    rows = f"SELECT '{KG}part' || p_partkey AS s, '{KG}brand' AS p, '{KG}' || lower(replace(p_brand, '#', '_')) AS o, 'uri' AS o_kind FROM part UNION SELECT '{KG}part' || p_partkey, '{KG}title', 'the \"' || p_name || '\"' || chr(9) || '\\ part', 'literal' FROM part"
    return {
        "ntriples_round_trip": rows,
        "turtle_round_trip": rows,
        "triple_file_round_trip": "SELECT 'paper=r' || n_regionkey AS paper, 'ab' || n_name AS s, 'in' AS p, CAST(n_regionkey AS VARCHAR) AS o FROM nation",
        "quad_file_round_trip": built()["call_tree_quads"],
        "label_file": "SELECT p_name || ', part' AS key, CAST(1 AS BIGINT) AS n FROM part GROUP BY p_name",
        "positional_file": "SELECT CAST(s_suppkey AS VARCHAR) AS k, s_name || '; \"x\"' AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier",
        "standoff_file": "SELECT 'Used-for' AS rel, 'T' || l_orderkey AS arg1, 'T1' AS arg2, CAST(l_orderkey AS INTEGER) AS start, CAST(l_orderkey + 4 AS INTEGER) AS \"end\", 'word' || l_orderkey AS text, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY l_orderkey",
        "owl_file": "WITH p AS (SELECT * FROM part), t AS (SELECT 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS t) SELECT 'p' || p_partkey AS s, t AS p, 'http://k.example/Part' AS o, 'uri' AS o_kind FROM p, t UNION SELECT 'p' || p_partkey, 'http://k.example/of', p_brand, 'uri' FROM p UNION SELECT p_brand, t, 'http://k.example/Brand', 'uri' FROM p, t UNION SELECT p_brand, 'http://k.example/size', CAST(p_size AS VARCHAR), 'literal' FROM p",
        "tei_file": "SELECT n_name AS title, 'One two three.' AS text, NULL AS head, 'shows ' || n_name AS caption FROM nation UNION ALL SELECT n_name, 'One two three.', 'Fig', NULL FROM nation",
        "context_file": "SELECT 'f' || s_suppkey AS name, 'a' AS \"left\", 'b^c' AS path, 'd' AS \"right\" FROM supplier UNION ALL SELECT 'f' || s_suppkey, 'z', CAST(s_nationkey AS VARCHAR), 'w' FROM supplier",
        "appended_numbers": "WITH k AS (SELECT DISTINCT stored_dir_name FROM paper WHERE batch_no = 0 AND stored_dir_name IS NOT NULL), n AS (SELECT DISTINCT stored_dir_name FROM paper WHERE batch_no > 0 AND stored_dir_name NOT IN (SELECT stored_dir_name FROM k)) SELECT stored_dir_name, row_number() OVER (ORDER BY stored_dir_name) - 1 + (SELECT count(*) FROM k) AS number FROM n",
    }
