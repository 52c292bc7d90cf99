"""Analytical questions over the publication graph: counts, co-occurrences and trends, asked as graph patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.plans.graph import EdgeTable, Graph, Pattern, PropertyTable, bind
from knotwork.plans.sparql import run
from knotwork.session import table

#: Entity classes by ``p_size % 6``.
CLASSES = ("Task", "Method", "Material", "Eval", "Other", "Generic")


def publication_graph(spark: SparkSession, d: str) -> Graph:
    """The graph of publications, entities, repositories and figures that the relational tables hold.

    An order is a publication, its parts are entities, its lines are functions of its repository, returned lines are
    components of its figure.
    """
    uri = lambda head, *parts: F.concat(F.lit(head), F.concat_ws("_", *parts))
    orders = lambda: table(spark, d, "orders")
    lines = lambda: table(spark, d, "lineitem")
    part = lambda: table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    entities = lambda: lines().select("l_orderkey", "l_partkey").distinct().join(part(), F.col("l_partkey") == F.col("p_partkey"))
    shown = lambda: lines().filter("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct().join(part(), F.col("l_partkey") == F.col("p_partkey"))

    def functions() -> DataFrame:
        nation = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey", "n_name")
        rows = lines().select("l_orderkey", "l_linenumber", "l_suppkey").join(nation, F.col("l_suppkey") == F.col("s_suppkey"))
        kind = F.when(F.col("n_nationkey") == 0, "UserDefined").otherwise(F.concat(F.lit("tf/"), "n_name"))
        return rows.select(uri("fn/", "l_orderkey", "l_linenumber").alias("s"), kind.alias("o"), uri("repo/", "l_orderkey").alias("repository"))

    klass = F.element_at(F.array(*map(F.lit, CLASSES)), F.pmod("p_size", F.lit(6)) + 1)
    return Graph(
        properties=[
            PropertyTable(
                orders,
                uri("pub/", "o_orderkey"),
                {
                    "type": F.lit("Publication"),
                    "conferenceSeries": F.col("o_orderpriority"),
                    "yearOfPublication": F.year("o_orderdate"),
                    "platform": F.when(F.col("o_orderstatus") == "F", "tensorflow").when(F.col("o_orderstatus") == "O", "pytorch").otherwise("other"),
                    "hasRepository": uri("repo/", "o_orderkey"),
                },
                "pub/",
            ),
            PropertyTable(
                entities,
                uri("ent/", "l_orderkey", "l_partkey"),
                {"type": klass, "hasText": F.col("p_name"), "hasCSOEquivalent": F.when((F.col("p_size") % 2 == 0) | (F.col("p_size") % 6 == 1), uri("cso/", "p_brand"))},
                "ent/",
                {"hasEntity": uri("pub/", "l_orderkey")},
            ),
            PropertyTable(shown, uri("comp/", "l_orderkey", "l_partkey"), {"partOf": uri("fig/", "l_orderkey"), "hasCSOEquivalent": uri("cso/", "p_brand")}, "comp/"),
        ],
        edges=[
            EdgeTable("hasEntity", lambda: lines().select(uri("pub/", "l_orderkey").alias("s"), uri("ent/", "l_orderkey", "l_partkey").alias("o")), "pub/"),
            EdgeTable("hasFigure", lambda: lines().filter("l_returnflag = 'R'").select(uri("pub/", "l_orderkey").alias("s"), uri("fig/", "l_orderkey").alias("o")), "pub/"),
            EdgeTable("hasFunction", lambda: lines().select(uri("repo/", "l_orderkey").alias("s"), uri("fn/", "l_orderkey", "l_linenumber").alias("o")), "repo/"),
            EdgeTable("type", functions, "fn/", owners={"hasFunction": "repository"}),
        ],
        namespaces={"kg": schema.KG, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"},
        ranges={"hasEntity": "ent/", "hasRepository": "repo/", "hasFunction": "fn/", "hasFigure": "fig/"},
    )


_STAR = "?s a kg:Publication ; kg:conferenceSeries ?conference ; kg:yearOfPublication ?year"
_CALLS = "?s kg:conferenceSeries ?conference ; kg:yearOfPublication ?year ; kg:hasRepository ?repository . ?repository kg:hasFunction ?y . ?y a ?type FILTER(!(STR(?type) = \"UserDefined\"))"
_PAIR = "?publication kg:hasEntity ?{a}entity ; kg:hasEntity ?{b}entity . ?{a}entity a kg:{A} . ?{b}entity a kg:{B}"

#: Questions in SPARQL by name; counts are named as the columns of the result.
TEXTS = {
    "pubs_by_year": f"SELECT ?year COUNT(DISTINCT ?s) AS ?Count WHERE {{ {_STAR} }} GROUP BY ?year ORDER BY DESC(?year)",
    "pubs_by_conf_year": f"SELECT COUNT(DISTINCT ?s) AS ?Count ?conference ?year WHERE {{ {_STAR} }}",
    "platform_by_year": f"SELECT COUNT(?platform) AS ?Count ?platform ?year WHERE {{ {_STAR} ; kg:platform ?platform }} GROUP BY ?platform ?year",
    "pytorch_by_year": f"SELECT COUNT(?platform) AS ?pytorch ?year WHERE {{ {_STAR} ; kg:platform ?platform FILTER(STR(?platform) = \"pytorch\") }} GROUP BY ?year",
    "tensorflow_by_year": f"SELECT COUNT(?platform) AS ?tensorflow ?year WHERE {{ {_STAR} ; kg:platform ?platform FILTER(STR(?platform) = \"tensorflow\") }} GROUP BY ?year",
    "function_by_conf": f"SELECT COUNT(?type) AS ?counttype ?type ?conference WHERE {{ {_CALLS} }} GROUP BY ?type ?conference ORDER BY DESC(?counttype)",
    "function_by_year": f"SELECT COUNT(?type) AS ?counttype ?type ?year WHERE {{ {_CALLS} }} GROUP BY ?type ?year ORDER BY DESC(?counttype)",
    "cso_types": "SELECT ?cso ?type WHERE { ?o kg:hasCSOEquivalent ?cso . ?o a ?type }",
    "cso_count_by_pub": "SELECT ?publication COUNT(?cso) AS ?countcso WHERE { ?publication a kg:Publication . ?publication kg:hasEntity ?entity . ?entity kg:hasCSOEquivalent ?cso } ORDER BY DESC(?countcso)",
    "cso_image": "SELECT DISTINCT ?publication ?cso WHERE { ?publication kg:hasFigure ?f . ?component kg:partOf ?f . ?component kg:hasCSOEquivalent ?cso }",
    "entity_type_cso": "SELECT ?type ?cso WHERE { ?s a kg:Publication . ?s kg:hasEntity ?o . ?o a ?type . ?o kg:hasCSOEquivalent ?cso }",
    "cso_distinct_by_type": "SELECT DISTINCT ?type COUNT(DISTINCT ?cso) AS ?csocount WHERE { ?s a kg:Publication . ?s kg:hasEntity ?o . ?o a ?type . ?o kg:hasCSOEquivalent ?cso } ORDER BY DESC(?csocount)",
    "task_dataset": f"SELECT DISTINCT ?task ?datasetentity WHERE {{ {_PAIR.format(a='task', b='dataset', A='Task', B='Material')} . ?taskentity kg:hasCSOEquivalent ?task }}",
    "task_dataset_text": f"SELECT DISTINCT ?tasktext ?datasettext WHERE {{ {_PAIR.format(a='task', b='dataset', A='Task', B='Material')} . ?taskentity kg:hasText ?tasktext . ?datasetentity kg:hasText ?datasettext }}",
    "method_task": f"SELECT DISTINCT ?method ?task WHERE {{ {_PAIR.format(a='method', b='task', A='Method', B='Task')} . ?methodentity kg:hasCSOEquivalent ?method . ?taskentity kg:hasCSOEquivalent ?task }}",
    "attention_audio": "SELECT DISTINCT ?publication, ?figure WHERE { ?publication kg:hasEntity ?method ; kg:hasEntity ?material . ?method a kg:Method . ?method kg:hasText \"red widget\" . ?material a kg:Material . ?material kg:hasText \"small ring\" }",
}


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumn("year", F.col("year").cast("int")) if "year" in df.columns else df


def ask(name: str):
    """The query of ``TEXTS`` with that name; years are integers."""
    return lambda spark, d: _typed(run(publication_graph(spark, d), TEXTS[name]))


def fan_out(branch: list[Pattern], key: str, tail_of: str):
    """Count of function types next to the values of ``key``.

    The pattern pairs every entity of a publication with every function of it. Both sides are counted per publication
    first and the counts multiplied, so the pairs are never made: the join has a row per (publication, value, type).
    """

    def query(spark: SparkSession, d: str) -> DataFrame:
        g = publication_graph(spark, d)
        left = bind(g, [*branch, Pattern("?s", "hasRepository", "?repository")], keep=["?s", f"?{key}", "?repository"])
        left = left.groupBy("?repository", f"?{key}").agg(F.count(F.lit(1)).alias("a"))
        right = bind(g, [Pattern("?repository", "hasFunction", "?y"), Pattern("?y", "type", "?type")], {"?type": [lambda c: c != "UserDefined"]}, keep=["?repository", "?type"])
        right = right.groupBy("?repository", "?type").agg(F.count(F.lit(1)).alias("b"))
        out = left.join(right, "?repository").groupBy(F.col(f"`?{key}`").alias(key), F.col("`?type`").alias("type")).agg(F.sum(F.col("a") * F.col("b")).alias("counttype"))
        return out.select("counttype", key, "type").orderBy(F.desc("counttype"), key, "type")

    return query


def entity_branch(klass: str, var: str) -> list[Pattern]:
    return [Pattern("?s", "hasEntity", "?e"), Pattern("?e", "type", klass), Pattern("?e", "hasCSOEquivalent", f"?{var}")]


FIGURE_BRANCH = [Pattern("?s", "hasFigure", "?f"), Pattern("?component", "partOf", "?f"), Pattern("?component", "hasCSOEquivalent", "?cso")]


def queries() -> dict:
    out = {name: ask(name) for name in TEXTS}
    out["method_function"] = fan_out(entity_branch("Method", "method"), "method", "s")
    out["task_function"] = fan_out(entity_branch("Task", "task"), "task", "s")
    out["image_function"] = fan_out(FIGURE_BRANCH, "cso", "s")
    out["predicate_frequency"] = lambda s, d: publication_graph(s, d).predicate_counts()
    out["function_over_threshold"] = lambda s, d: _typed(run(publication_graph(s, d), TEXTS["function_by_conf"])).filter("counttype > 10")
    out["conf_year_size_pivot"] = lambda s, d: ask("pubs_by_conf_year")(s, d).groupBy("year").pivot("conference").agg(F.count(F.lit(1)))
    out["conf_year_count_pivot"] = lambda s, d: ask("pubs_by_conf_year")(s, d).groupBy("year").pivot("conference").agg(F.sum("Count"))
    out["conf_year_platform_cube"] = lambda s, d: _typed(
        bind(publication_graph(s, d), [Pattern("?s", "conferenceSeries", "?conference"), Pattern("?s", "yearOfPublication", "?year"), Pattern("?s", "platform", "?platform")])
        .select(*(F.col(f"`?{c}`").alias(c) for c in ("conference", "year", "platform")))
        .cube("conference", "year", "platform").agg(F.count(F.lit(1)).alias("n"))
    )
    out["triple_pattern_access"] = lambda s, d: publication_graph(s, d).match(p="platform", o="pytorch").select("s")
    return out


_CTE = """WITH pub AS (SELECT 'pub/' || o_orderkey AS s, o_orderpriority AS conference, CAST(year(o_orderdate) AS INTEGER) AS year,
  CASE o_orderstatus WHEN 'F' THEN 'tensorflow' WHEN 'O' THEN 'pytorch' ELSE 'other' END AS platform, 'repo/' || o_orderkey AS repository FROM orders),
ent AS (SELECT DISTINCT 'pub/' || l_orderkey AS s, 'ent/' || l_orderkey || '_' || l_partkey AS e, p_name AS txt,
  CASE p_size % 6 WHEN 0 THEN 'Task' WHEN 1 THEN 'Method' WHEN 2 THEN 'Material' WHEN 3 THEN 'Eval' WHEN 4 THEN 'Other' ELSE 'Generic' END AS type,
  CASE WHEN p_size % 2 = 0 OR p_size % 6 = 1 THEN 'cso/' || p_brand END AS cso FROM lineitem JOIN part ON l_partkey = p_partkey),
fn AS (SELECT DISTINCT 'repo/' || l_orderkey AS repository, 'fn/' || l_orderkey || '_' || l_linenumber AS f, CASE WHEN n_nationkey = 0 THEN 'UserDefined' ELSE 'tf/' || n_name END AS type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
comp AS (SELECT DISTINCT 'pub/' || l_orderkey AS s, 'comp/' || l_orderkey || '_' || l_partkey AS c, 'cso/' || p_brand AS cso FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R')
"""
_CALL_ROWS = "FROM pub JOIN fn USING (repository) WHERE type <> 'UserDefined'"


def oracle_sql() -> dict[str, str]:
    sql = {
        "pubs_by_year": "SELECT year, count(DISTINCT s) AS Count FROM pub GROUP BY year",
        "pubs_by_conf_year": "SELECT count(DISTINCT s) AS Count, conference, year FROM pub GROUP BY conference, year",
        "platform_by_year": "SELECT count(*) AS Count, platform, year FROM pub GROUP BY platform, year",
        "pytorch_by_year": "SELECT count(*) AS pytorch, year FROM pub WHERE platform = 'pytorch' GROUP BY year",
        "tensorflow_by_year": "SELECT count(*) AS tensorflow, year FROM pub WHERE platform = 'tensorflow' GROUP BY year",
        "function_by_conf": f"SELECT count(*) AS counttype, type, conference {_CALL_ROWS} GROUP BY type, conference",
        "function_by_year": f"SELECT count(*) AS counttype, type, year {_CALL_ROWS} GROUP BY type, year",
        "function_over_threshold": f"SELECT count(*) AS counttype, type, conference {_CALL_ROWS} GROUP BY type, conference HAVING count(*) > 10",
        "cso_types": "SELECT cso, type FROM ent WHERE cso IS NOT NULL",
        "cso_count_by_pub": "SELECT s AS publication, count(*) AS countcso FROM ent JOIN pub USING (s) WHERE cso IS NOT NULL GROUP BY s",
        "cso_image": "SELECT DISTINCT s AS publication, cso FROM comp",
        "entity_type_cso": "SELECT type, cso FROM ent JOIN pub USING (s) WHERE cso IS NOT NULL",
        "cso_distinct_by_type": "SELECT type, count(DISTINCT cso) AS csocount FROM ent JOIN pub USING (s) WHERE cso IS NOT NULL GROUP BY type",
        "task_dataset": "SELECT DISTINCT a.cso AS task, b.e AS datasetentity FROM ent a JOIN ent b ON a.s = b.s WHERE a.type = 'Task' AND b.type = 'Material' AND a.cso IS NOT NULL",
        "task_dataset_text": "SELECT DISTINCT a.txt AS tasktext, b.txt AS datasettext FROM ent a JOIN ent b ON a.s = b.s WHERE a.type = 'Task' AND b.type = 'Material'",
        "method_task": "SELECT DISTINCT a.cso AS method, b.cso AS task FROM ent a JOIN ent b ON a.s = b.s WHERE a.type = 'Method' AND b.type = 'Task' AND a.cso IS NOT NULL AND b.cso IS NOT NULL",
        "attention_audio": "SELECT DISTINCT a.s AS publication, CAST(NULL AS VARCHAR) AS figure FROM ent a JOIN ent b ON a.s = b.s WHERE a.type = 'Method' AND a.txt = 'red widget' AND b.type = 'Material' AND b.txt = 'small ring'",
        "predicate_frequency": """SELECT p, count(*) AS n FROM (
          SELECT s, 'type' AS p, 'Publication' AS o FROM pub UNION SELECT s, 'conferenceSeries', conference FROM pub UNION SELECT s, 'yearOfPublication', CAST(year AS VARCHAR) FROM pub
          UNION SELECT s, 'platform', platform FROM pub UNION SELECT s, 'hasRepository', repository FROM pub UNION SELECT e, 'type', type FROM ent UNION SELECT e, 'hasText', txt FROM ent
          UNION SELECT e, 'hasCSOEquivalent', cso FROM ent WHERE cso IS NOT NULL UNION SELECT s, 'hasEntity', e FROM ent UNION SELECT repository, 'hasFunction', f FROM fn UNION SELECT f, 'type', type FROM fn
          UNION SELECT c, 'partOf', replace(s, 'pub/', 'fig/') FROM comp UNION SELECT c, 'hasCSOEquivalent', cso FROM comp UNION SELECT s, 'hasFigure', replace(s, 'pub/', 'fig/') FROM comp) GROUP BY p""",
        "conf_year_platform_cube": "SELECT conference, year, platform, count(*) AS n FROM pub GROUP BY CUBE (conference, year, platform)",
        "triple_pattern_access": "SELECT s FROM pub WHERE platform = 'pytorch'",
    }
    for name, kind, key in (("method_function", "Method", "method"), ("task_function", "Task", "task")):
        sql[name] = f"SELECT count(*) AS counttype, ent.cso AS {key}, fn.type AS type FROM ent JOIN pub USING (s) JOIN fn USING (repository) WHERE ent.type = '{kind}' AND ent.cso IS NOT NULL AND fn.type <> 'UserDefined' GROUP BY ent.cso, fn.type"
    sql["image_function"] = "SELECT count(*) AS counttype, comp.cso AS cso, fn.type AS type FROM comp JOIN pub USING (s) JOIN fn USING (repository) WHERE fn.type <> 'UserDefined' GROUP BY comp.cso, fn.type"
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    size = ", ".join(f"nullif(count(DISTINCT conference) FILTER (conference = '{n}'), 0) AS \"{n}\"" for n in names)
    total = ", ".join(f"CAST(nullif(count(*) FILTER (conference = '{n}'), 0) AS BIGINT) AS \"{n}\"" for n in names)
    sql["conf_year_size_pivot"] = f"SELECT year, {size} FROM pub GROUP BY year"
    sql["conf_year_count_pivot"] = f"SELECT year, {total} FROM pub GROUP BY year"
    return {name: _CTE + text for name, text in sql.items()}
