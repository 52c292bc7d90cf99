"""The graph of publications from extracted facts: triples of texts, figures, repositories and call trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions import strings as S
from knotwork.operators.tabular import first_seen
from knotwork.session import stage_table, table

# Classes of figure parts.
BLOCKS = {
    "Figure": "Figure",
    "conv": "ConvBlock",
    "deconv": "DeconvBlock",
    "dense": "DenseBlock",
    "flatten": "FlattenBlock",
    "dropout": "DropoutBlock",
    "pooling": "PoolingBlock",
    "unpooling": "UnpoolingBlock",
    "concat": "ConcatBlock",
    "rnn": "RnnBlock",
    "rnnseq": "RnnSeqBlock",
    "lstm": "LSTMBlock",
    "lstmseq": "LSTMSeqBlock",
    "norm": "NormBlock",
    "embed": "EmbedBlock",
    "activation": "ActivationBlock",
    "loss": "LossBlock",
    "output": "OutputBlock",
    "input": "InputBlock",
    "upsample": "UpsamplingBlock",
}
#: Part of an address that tells an ontology topic from addresses made here.
GUARD = "cso"


def spread(df: DataFrame, triples: list[tuple[Column, Column | str, Column]]) -> DataFrame:
    """(s, p, o) of several triples per row, each row read once; triples with a null go."""
    cell = lambda c: c.cast("string") if isinstance(c, Column) else F.lit(c)
    each = F.array(*(F.struct(cell(s).alias("s"), cell(p).alias("p"), cell(o).alias("o")) for s, p, o in triples))
    return df.select(F.explode(each).alias("t")).select("t.*").filter("s is not null and p is not null and o is not null")


def text_triples(papers: DataFrame, entities: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Triples of publications (link, year, conference, platform) and their entities (link, text, label, seq).

    Of a text the first label of the paper counts. An entity is named by its paper and its text with ``_`` for blanks; it
    is linked to the address that the map (term, uri) has for that text if the address is one of the ontology's.
    """
    paper = S.file_stem(F.col("link"))
    about = spread(papers.withColumn("k", paper), [(F.col("k"), "type", F.lit("Publication")), *((F.col("k"), p, F.col(c)) for p, c in (("yearOfPublication", "year"), ("conferenceSeries", "conference"), ("platform", "platform")))])
    named = entities.filter("text is not null and text <> ''").select(paper.alias("k"), S.underscored(F.col("text")).alias("text"), "label", "seq")
    first = first_seen(named, ["k", "text"], ["seq"])
    linked = first.join(entity_map.select(F.col("term").alias("text"), "uri"), "text", "left").withColumn("e", F.concat_ws("_", "k", "text"))
    topic = F.when(F.contains("uri", F.lit(GUARD)), F.col("uri"))
    of = spread(linked, [(F.col("k"), "hasEntity", F.col("e")), (F.col("e"), "type", F.col("label")), (F.col("e"), "hasText", F.col("text")), (F.col("e"), "hasCSOEquivalent", topic)])
    return about.unionByName(of).distinct()


def image_triples(lines: DataFrame, entity_map: DataFrame) -> DataFrame:
    """Triples of figure lines (paper, s, p, o): figures, captions, parts and their classes; other predicates are left out.

    Figures keep their name, a part is named by its paper and its own name; classes without an entry in ``BLOCKS`` give no
    triple, those that the map knows as an ontology topic are linked to it.
    """
    block = F.create_map(*(F.lit(x) for kv in BLOCKS.items() for x in kv))
    rows = lines.join(entity_map.select(F.col("term").alias("o"), "uri"), "o", "left").withColumn("part", F.concat_ws("_", "paper", "s"))
    when = lambda p, c: F.when(F.col("p") == p, c)
    return spread(
        rows,
        [
            (F.col("part"), "partOf", when("partOf", F.col("o"))),
            (F.col("s"), "hasCaptionText", when("hasCaption", F.col("o"))),
            (when("isA", F.col("paper")), "hasFigure", F.when(F.col("o") == "Figure", F.col("s"))),
            (F.col("s"), "type", when("isA", F.try_element_at(block, F.col("o")))),
            (F.col("part"), "type", when("isType", F.try_element_at(block, F.col("o")))),
            (F.col("part"), "hasCSOEquivalent", when("isType", F.when(F.contains("uri", F.lit(GUARD)), F.col("uri")))),
        ],
    ).distinct()


def metadata_triples(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Triples of repositories: their publication (by the link of the paper, else by the folder), code link and files."""
    pub = F.coalesce(S.file_stem(F.col("paper_link")), F.col("dir_name"))
    about = spread(metadata, [(F.col("dir_name"), "type", F.lit("Repository")), (pub, "hasRepository", F.col("dir_name")), (F.col("dir_name"), "githubrepo", F.col("code_link"))])
    name = F.concat_ws("/", "stored_dir_name", F.element_at(F.split("code_path", "/"), -1))
    known = files.filter("code_path is not null").join(metadata.select(F.col("dir_name").alias("stored_dir_name")), "stored_dir_name", "left_semi").withColumn("f", name)
    return about.unionByName(spread(known, [(F.col("stored_dir_name"), "hasFile", F.col("f")), (F.col("f"), "isPartOf", F.col("stored_dir_name"))])).distinct()


def repository_papers(folders: DataFrame, papers: DataFrame) -> DataFrame:
    """(stored_dir_name, paper_id): the first paper of each code folder, null if it has none."""
    first = papers.filter("stored_dir_name is not null").groupBy("stored_dir_name").agg(F.min("paper_id").alias("paper_id"))
    return folders.select("stored_dir_name").filter("stored_dir_name is not null").distinct().join(first, "stored_dir_name", "left")


def named_trees(nodes: DataFrame) -> DataFrame:
    """Nodes of call trees with ``idx`` (like 1-0-2), ``rdf_name`` (names down from the root, each with its place) and ``path``.

    ``nodes`` has node, parent (null for roots), child_idx and name. Line ends, tabs and runs of four blanks leave names.
    Levels are joined one after another to the last; ``path`` orders nodes in pre-order without any sort of whole trees.
    """
    clean = nodes.withColumn("name", F.regexp_replace("name", r"[\n\t]|    ", ""))
    level = stage_table(clean.filter("parent is null").withColumns({"root": F.col("name"), "idx": F.lit("1"), "rdf_name": F.col("name"), "path": F.lpad(F.col("child_idx").cast("string"), 6, "0")}), "level")
    out = level
    while not level.isEmpty():
        up = level.select(F.col("node").alias("parent"), "root", F.col("idx").alias("i"), F.col("rdf_name").alias("r"), F.col("path").alias("q"))
        step = clean.join(up, "parent").withColumns(
            {"idx": F.concat_ws("-", "i", F.col("child_idx").cast("string")), "rdf_name": F.concat(F.col("r"), F.lit("."), F.col("name"), F.lit("_"), F.col("child_idx").cast("string")), "path": F.concat_ws("-", "q", F.lpad(F.col("child_idx").cast("string"), 6, "0"))}
        )
        level = stage_table(step.select(*out.columns), "level")
        out = out.unionByName(level)
    return out


def _siblings(trees: DataFrame) -> DataFrame:
    """(parent, name, rdf_name, next_name, next): consecutive children of a node, by an equi-join on the place."""
    nxt = trees.filter("child_idx > 0 and parent is not null").select("parent", (F.col("child_idx") - 1).alias("child_idx"), F.col("name").alias("next_name"), F.col("rdf_name").alias("next"))
    return trees.filter("parent is not null").select("parent", "child_idx", "name", "rdf_name").join(nxt, ["parent", "child_idx"])


def argument_triples(trees: DataFrame, subject: str = "rdf_name") -> DataFrame:
    """Triples of arguments and keywords. Exactly three arguments are an output size and a kernel of two sizes."""
    args, s = F.col("args"), F.col(subject)
    three = F.size("args") == 3
    sizes = spread(trees.filter(three), [(s, "has_output_feature_size", args[0]), (s, "has_kernel_size", F.concat(F.lit("("), args[1], F.lit(","), args[2], F.lit(")")))])
    other = trees.filter(~three).select(s.alias("s"), F.explode("args").alias("o")).select("s", F.lit("has_arg").alias("p"), F.regexp_replace("o", r"[\n\t ]", "").alias("o"))
    words = trees.filter("keywords is not null").select(s.alias("s"), F.explode("keywords").alias("k", "o")).select("s", F.concat(F.lit("has_keyword_"), "k").alias("p"), F.col("o").cast("string").alias("o"))
    return sizes.unionByName(other).unionByName(words)


def tree_triples(trees: DataFrame, repo: str) -> DataFrame:
    """Triples of call trees from :func:`named_trees`: functions of the repository, their types and labels, calls, order, arguments.

    A node of type ``tf_keyword`` has its url as type; any other is user-defined and has its name as label.
    """
    own = F.col("type") != "tf_keyword"
    me = F.col("rdf_name")
    about = spread(trees, [(F.lit(repo), "hasFunction", me), (me, "type", F.when(own, F.lit("UserDefined")).otherwise(F.col("url"))), (me, "label", F.when(own, F.col("name")))])
    up = trees.select(F.col("node").alias("parent"), F.col("rdf_name").alias("s"))
    calls = trees.filter("parent is not null").join(up, "parent").select("s", F.lit("calls").alias("p"), me.alias("o"))
    follows = _siblings(trees).select(me.alias("s"), F.lit("followedBy").alias("p"), F.col("next").alias("o"))
    return about.unionByName(calls).unionByName(follows).unionByName(argument_triples(trees)).distinct()


def tree_quads(trees: DataFrame) -> DataFrame:
    """(s, p, o, idx) of call trees by plain names: root, type, calls, order, arguments by number, keywords; a row per fact, not a set."""
    up = trees.select(F.col("node").alias("parent"), F.col("name").alias("s"), F.col("idx").alias("at"))
    kind = F.when(F.col("type") == "tf_keyword", F.col("url")).otherwise(F.col("type"))
    quad = lambda df, s, p, o, i: df.select(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), i.alias("idx"))
    name, idx = F.col("name"), F.col("idx")
    parts = [
        quad(trees.filter("name <> root"), name, F.lit("has_root"), F.col("root"), idx),
        quad(trees, name, F.lit("type"), kind, idx),
        quad(trees.filter("parent is not null").join(up, "parent"), F.col("s"), F.lit("call"), name, F.col("at")),
        quad(_siblings(trees).join(up, "parent"), name, F.lit("followed_by"), F.col("next_name"), F.col("at")),
        quad(trees.select(name, idx, "args", F.posexplode("args").alias("k", "a")).filter("size(args) <> 3"), name, F.concat(F.lit("has_arg"), F.col("k").cast("string")), F.col("a"), idx),
        quad(trees.filter("size(args) = 3"), name, F.lit("has_output_feature_size"), F.col("args")[0], idx),
        quad(trees.filter("size(args) = 3"), name, F.lit("has_kernel_size"), F.concat(F.lit("("), F.col("args")[1], F.lit(","), F.col("args")[2], F.lit(")")), idx),
        quad(trees.filter("keywords is not null").select(name, idx, F.explode("keywords").alias("k", "v")), name, F.concat(F.lit("has_"), "k"), F.col("v"), idx),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tree_sequence(trees: DataFrame) -> DataFrame:
    """(root, path, k, item): names of API calls, arguments and keyword values; in the order of path and k they stand in pre-order."""
    call = F.when(F.col("type") == "tf_keyword", F.array("name")).otherwise(F.array().cast("array<string>"))
    items = F.concat(call, F.coalesce("args", F.array().cast("array<string>")), F.coalesce(F.map_values("keywords"), F.array().cast("array<string>")))
    return trees.select("root", "path", F.posexplode(items).alias("k", "item"))


def _trees(s, d) -> DataFrame:
    """The parts as one call tree in heap order: the children of k are 3k - 1 to 3k + 1."""
    k, size = F.col("p_partkey"), F.col("p_size")
    args = F.slice(F.array(size.cast("string"), F.pmod(k, F.lit(7)).cast("string"), F.col("p_brand")), F.lit(1), F.pmod(size, F.lit(4)))
    return table(s, d, "part").select(
        k.alias("node"), F.when(k > 1, F.floor((k + 1) / 3)).alias("parent"), F.when(k > 1, F.pmod(k + 1, F.lit(3))).otherwise(0).cast("int").alias("child_idx"), S.underscored(F.col("p_name")).alias("name"),
        F.when(size % 3 == 0, "tf_keyword").otherwise("function").alias("type"), F.concat(F.lit("tf/"), "p_brand").alias("url"), args.alias("args"), F.when(size % 2 == 0, F.create_map(F.lit("units"), size.cast("string"))).alias("keywords"),
    )


_TREE_SQL = """WITH RECURSIVE t AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN (p_partkey + 1) // 3 END AS parent, CASE WHEN p_partkey > 1 THEN (p_partkey + 1) % 3 ELSE 0 END AS k, replace(p_name, ' ', '_') AS name, p_size % 3 = 0 AS api, 'tf/' || p_brand AS url,
  [CAST(p_size AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR), p_brand][1:p_size % 4] AS args, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS units FROM part),
r AS (SELECT t.*, name AS root, '1' AS idx, name AS rdf, lpad(CAST(k AS VARCHAR), 6, '0') AS path FROM t WHERE parent IS NULL
  UNION ALL SELECT t.*, r.root, r.idx || '-' || t.k, r.rdf || '.' || t.name || '_' || t.k, r.path || '-' || lpad(CAST(t.k AS VARCHAR), 6, '0') FROM t JOIN r ON t.parent = r.node)"""


def queries() -> dict:
    lines = lambda s, d: table(s, d, "lineitem")
    link = lambda: F.concat(F.lit("http://papers.example/"), F.col("l_orderkey").cast("string"), F.lit(".pdf"))

    def papers(s, d):
        o = F.concat(F.lit("http://papers.example/"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))
        return table(s, d, "orders").select(o.alias("link"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("conference"), F.when(F.col("o_orderstatus") == "F", "tensorflow").otherwise("pytorch").alias("platform"))

    def entities(s, d):
        kind = F.element_at(F.array(*map(F.lit, ("Task", "Method", "Material", "Eval"))), F.pmod("p_size", F.lit(4)) + 1)
        return lines(s, d).join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(link().alias("link"), F.col("p_name").alias("text"), kind.alias("label"), F.struct("l_linenumber", "l_partkey").alias("seq"))

    def entity_map(s, d):
        m = table(s, d, "part").groupBy(S.underscored(F.col("p_name")).alias("term")).agg(F.min_by(F.struct("p_size", "p_brand"), "p_partkey").alias("m"))
        return m.select("term", F.concat(F.when(F.col("m.p_size") % 2 == 0, "http://cso.example/").otherwise("http://own.example/"), F.col("m.p_brand")).alias("uri"))

    def figures(s, d):
        rows = lines(s, d).filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
        block = F.element_at(F.array(*map(F.lit, ("conv", "dense", "lstm", "unknown"))), F.pmod("l_partkey", F.lit(4)).cast("int") + 1)
        fig, comp = F.concat(F.lit("fig"), "l_orderkey"), F.concat_ws("_", F.lit("Comp"), "l_linenumber", "l_partkey")
        facts = [(fig, "isA", F.lit("Figure")), (fig, "hasCaption", F.concat(F.lit("caption of "), fig)), (comp, "partOf", fig), (comp, "isType", block), (comp, "hasPos", F.lit("1,2"))]
        each = F.array(*(F.struct(a.alias("s"), F.lit(p).alias("p"), o.alias("o")) for a, p, o in facts))
        return rows.select(F.concat(F.lit("pub"), "l_orderkey").alias("paper"), F.explode(each).alias("x")).select("paper", "x.*")

    def blocks(s, d):
        return s.createDataFrame([("conv", "http://cso.example/convolution"), ("dense", "http://own.example/dense")], "term string, uri string")

    return {
        "text_triples": lambda s, d: text_triples(papers(s, d), entities(s, d), entity_map(s, d)),
        "image_triples": lambda s, d: image_triples(figures(s, d), blocks(s, d)),
        "metadata_triples": lambda s, d: metadata_triples(table(s, d, "metadata").filter("dir_name is not null"), table(s, d, "repo")),
        "repository_papers": lambda s, d: repository_papers(table(s, d, "repo"), table(s, d, "paper")),
        "call_tree_names": lambda s, d: named_trees(_trees(s, d)).select("node", "root", "idx", "rdf_name", "path"),
        "call_tree_triples": lambda s, d: tree_triples(named_trees(_trees(s, d)), "repo/1"),
        "call_tree_quads": lambda s, d: tree_quads(named_trees(_trees(s, d))),
        "call_tree_sequence": lambda s, d: tree_sequence(named_trees(_trees(s, d))),
        "argument_triples": lambda s, d: argument_triples(_trees(s, d), "name"),
    }


def oracle_sql() -> dict[str, str]:
    args = lambda name: (
        f"SELECT {name} AS s, 'has_output_feature_size' AS p, args[1] AS o FROM r WHERE len(args) = 3 UNION ALL SELECT {name}, 'has_kernel_size', '(' || args[2] || ',' || args[3] || ')' FROM r WHERE len(args) = 3 "
        f"UNION ALL SELECT {name}, 'has_arg', replace(unnest(args), ' ', '') FROM r WHERE len(args) IN (1, 2) UNION ALL SELECT {name}, 'has_keyword_units', units FROM r WHERE units IS NOT NULL"
    )
    return {
        "text_triples": """WITH e AS (SELECT l_orderkey AS k, replace(p_name, ' ', '_') AS txt, arg_min(['Task', 'Method', 'Material', 'Eval'][p_size % 4 + 1], (l_linenumber, l_partkey)) AS label FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
          m AS (SELECT replace(p_name, ' ', '_') AS txt, arg_min(p_size, p_partkey) AS size, arg_min(p_brand, p_partkey) AS brand FROM part GROUP BY 1), j AS (SELECT k || '_' || txt AS e, * FROM e LEFT JOIN m USING (txt))
          SELECT CAST(o_orderkey AS VARCHAR) AS s, 'type' AS p, 'Publication' AS o FROM orders UNION SELECT CAST(o_orderkey AS VARCHAR), 'yearOfPublication', CAST(year(o_orderdate) AS VARCHAR) FROM orders UNION SELECT CAST(o_orderkey AS VARCHAR), 'conferenceSeries', o_orderpriority FROM orders
          UNION SELECT CAST(o_orderkey AS VARCHAR), 'platform', CASE o_orderstatus WHEN 'F' THEN 'tensorflow' ELSE 'pytorch' END FROM orders UNION SELECT CAST(k AS VARCHAR), 'hasEntity', e FROM j UNION SELECT e, 'type', label FROM j UNION SELECT e, 'hasText', txt FROM j
          UNION SELECT e, 'hasCSOEquivalent', 'http://cso.example/' || brand FROM j WHERE size % 2 = 0""",
        "image_triples": """WITH c AS (SELECT DISTINCT 'pub' || l_orderkey AS pub, 'fig' || l_orderkey AS fig, 'pub' || l_orderkey || '_Comp_' || l_linenumber || '_' || l_partkey AS comp, l_partkey % 4 AS b FROM lineitem WHERE l_returnflag = 'R')
          SELECT comp AS s, 'partOf' AS p, fig AS o FROM c UNION SELECT fig, 'hasCaptionText', 'caption of ' || fig FROM c UNION SELECT pub, 'hasFigure', fig FROM c UNION SELECT fig, 'type', 'Figure' FROM c
          UNION SELECT comp, 'type', ['ConvBlock', 'DenseBlock', 'LSTMBlock'][b + 1] FROM c WHERE b < 3 UNION SELECT comp, 'hasCSOEquivalent', 'http://cso.example/convolution' FROM c WHERE b = 0""",
        "metadata_triples": """WITH m AS (SELECT DISTINCT dir_name AS d, coalesce(regexp_replace(split_part(paper_link, '/', -1), '\\.(pdf|html)$', ''), dir_name) AS pub, code_link FROM metadata WHERE dir_name IS NOT NULL),
          f AS (SELECT DISTINCT stored_dir_name AS d, stored_dir_name || '/' || split_part(code_path, '/', -1) AS f FROM repo WHERE code_path IS NOT NULL AND stored_dir_name IN (SELECT d FROM m))
          SELECT d AS s, 'type' AS p, 'Repository' AS o FROM m UNION SELECT pub, 'hasRepository', d FROM m UNION SELECT d, 'githubrepo', code_link FROM m WHERE code_link IS NOT NULL UNION SELECT d, 'hasFile', f FROM f UNION SELECT f, 'isPartOf', d FROM f""",
        "repository_papers": "SELECT stored_dir_name, min(paper_id) AS paper_id FROM (SELECT DISTINCT stored_dir_name FROM repo WHERE stored_dir_name IS NOT NULL) LEFT JOIN paper USING (stored_dir_name) GROUP BY stored_dir_name",
        "call_tree_names": f"{_TREE_SQL} SELECT node, root, idx, rdf AS rdf_name, path FROM r",
        "call_tree_triples": f"{_TREE_SQL} SELECT 'repo/1' AS s, 'hasFunction' AS p, rdf AS o FROM r UNION SELECT rdf, 'type', CASE WHEN api THEN url ELSE 'UserDefined' END FROM r UNION SELECT rdf, 'label', name FROM r WHERE NOT api UNION SELECT a.rdf, 'calls', b.rdf FROM r a JOIN r b ON b.parent = a.node UNION SELECT a.rdf, 'followedBy', b.rdf FROM r a JOIN r b ON a.parent = b.parent AND b.k = a.k + 1 UNION SELECT * FROM ({args('rdf')})",
        "call_tree_quads": f"{_TREE_SQL} SELECT name AS s, 'has_root' AS p, root AS o, idx FROM r WHERE name <> root UNION ALL SELECT name, 'type', CASE WHEN api THEN url ELSE 'function' END, idx FROM r UNION ALL SELECT a.name, 'call', b.name, a.idx FROM r a JOIN r b ON b.parent = a.node UNION ALL SELECT a.name, 'followed_by', b.name, c.idx FROM r a JOIN r b ON a.parent = b.parent AND b.k = a.k + 1 JOIN r c ON c.node = a.parent UNION ALL SELECT name, 'has_arg' || (i - 1), args[i], idx FROM r, range(1, 3) t(i) WHERE len(args) < 3 AND i <= len(args) UNION ALL SELECT name, 'has_output_feature_size', args[1], idx FROM r WHERE len(args) = 3 UNION ALL SELECT name, 'has_kernel_size', '(' || args[2] || ',' || args[3] || ')', idx FROM r WHERE len(args) = 3 UNION ALL SELECT name, 'has_units', units, idx FROM r WHERE units IS NOT NULL",
        "call_tree_sequence": f"{_TREE_SQL}, i AS (SELECT root, path, list_concat(CASE WHEN api THEN [name] ELSE [] END, list_concat(args, CASE WHEN units IS NULL THEN [] ELSE [units] END)) AS items FROM r) SELECT root, path, CAST(k - 1 AS INTEGER) AS k, items[k] AS item FROM i, range(1, 6) t(k) WHERE k <= len(items)",
        "argument_triples": f"WITH r AS (SELECT replace(p_name, ' ', '_') AS name, [CAST(p_size AS VARCHAR), CAST(p_partkey % 7 AS VARCHAR), p_brand][1:p_size % 4] AS args, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS units FROM part) {args('name')}",
    }
