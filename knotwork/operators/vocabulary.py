"""Vocabularies of terms: topic maps with preferences, merged annotations, components of equal terms, spelling, likeness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import strings as S
from knotwork.operators.closure import components
from knotwork.session import table


def topic_terms(triples: DataFrame, prefer: str = "preferentialEquivalent") -> DataFrame:
    """(term, uri): labels and abbreviations of all topics with the preferred topic, in two steps.

    The first step finds the preferred topic of each (itself by default, the least where several are named); the second
    gives every label the preferred topic of the topics that carry it, the least where they differ.
    """
    topics = triples.select(F.col("s").alias("uri")).union(triples.select("o")).distinct()
    preferred = triples.filter(F.col("p") == prefer).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("best"))
    named = topics.join(preferred, "uri", "left").select(F.coalesce("best", "uri").alias("uri"), S.topic_label(F.col("uri")).alias("t"))
    terms = named.select(F.explode(F.array("t.label", "t.abbreviation")).alias("term"), "uri").filter("term is not null and term <> ''")
    return terms.groupBy("term").agg(F.min("uri").alias("uri"))


def topic_relations(triples: DataFrame, prefer: str = "preferentialEquivalent") -> DataFrame:
    """(src, rel, dst) between preferred topics: what is above another is turned into ``isA`` from the narrower one."""
    preferred = triples.filter(F.col("p") == prefer).groupBy(F.col("s").alias("k")).agg(F.min("o").alias("best"))
    rows = triples.filter(F.col("p").isin("superTopicOf", "contributesTo"))
    for end in ("s", "o"):
        rows = rows.join(preferred.select(F.col("k").alias(end), F.col("best").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    up = F.col("p") == "superTopicOf"
    return rows.select(F.when(up, F.col("_o")).otherwise(F.col("_s")).alias("src"), F.when(up, "isA").otherwise("contributesTo").alias("rel"), F.when(up, F.col("_s")).otherwise(F.col("_o")).alias("dst")).distinct()


def equivalence_sets(terms: DataFrame) -> DataFrame:
    """(uri, terms): all terms of one address, in order."""
    return terms.groupBy("uri").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def relation_texts(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc, pair, rel) of relations whose two annotations are known; the pair is both texts joined by ``--``."""
    side = lambda k: entities.select("doc", F.col("id").alias(f"arg{k}"), F.col("text").alias(f"text{k}"))
    return relations.join(side(1), ["doc", "arg1"]).join(side(2), ["doc", "arg2"]).select("doc", F.concat_ws("--", "text1", "text2").alias("pair"), "rel")


def remapped(rows: DataFrame, label: str, dropped: tuple[str, ...] = ("Coref",)) -> DataFrame:
    """Rows without dropped labels; others in lower case with a capital, ``-`` and ``_`` read as one blank."""
    return rows.filter(~F.col(label).isin(*dropped)).withColumn(label, F.initcap(F.lower(F.regexp_replace(label, "[-_]", " "))))


def resolved(relations: DataFrame, terms: DataFrame) -> DataFrame:
    """(src, rel, dst) of relations (a, rel, b) whose two terms both have an address."""
    end = lambda c, to: terms.select(F.col("term").alias(c), F.col("uri").alias(to))
    return relations.join(end("a", "src"), "a").join(end("b", "dst"), "b").select("src", "rel", "dst").distinct()


def same_as_terms(pairs: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((term, uri), (component, term, uri, chosen)): addresses spread over groups of equal terms, and the conflicts.

    ``pairs`` (src, dst) says that terms are equal. A group takes the address of its first known term in order; members
    with another address keep theirs and are reported; groups without any are left out.
    """
    member = components(pairs).withColumnRenamed("node", "term").join(known, "term", "left")
    chosen = member.filter("uri is not null").groupBy("component").agg(F.min_by("uri", "term").alias("chosen"))
    rows = member.join(chosen, "component")
    return rows.select("term", F.coalesce("uri", "chosen").alias("uri")), rows.filter("uri <> chosen").select("component", "term", "uri", "chosen")


def _deletes(c, most: int):
    """The word and what is left of it after one or two letters are taken out; of longer words than 30 letters one."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.expr("''"), F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = F.when(F.length(c) > 1, cut(c)).otherwise(F.array().cast("array<string>"))
    two = F.when((F.length(c) > 2) & (F.length(c) <= 30), F.flatten(F.transform(one, cut))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), one, *([two] if most > 1 else [])))


def spelled(words: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """(word, spelled): words as the dictionary (term, rank, n) has them, within ``most`` edits.

    Both sides are joined on what is left after up to ``most`` letters are taken out, so no word meets a term that it can't
    become, and edits are counted exactly. The least rank (the list of the figure before that of the field before the
    general one) counts first, then fewer edits, then the larger n, then the order of terms. Other words stay.
    """
    w = words.select("word").filter("word is not null").distinct()
    t = dictionary.select("term", "rank", "n")
    met = w.select("word", F.explode(_deletes(F.col("word"), most)).alias("k")).join(t.select("term", F.explode(_deletes(F.col("term"), most)).alias("k")).distinct(), "k").select("word", "term").distinct()
    near = met.withColumn("edits", F.levenshtein("word", "term", most)).filter("edits >= 0").join(t, "term")
    best = near.groupBy("word").agg(F.min(F.struct("rank", "edits", (-F.col("n")).alias("n"), "term")).alias("b"))
    return w.join(best, "word", "left").select("word", F.coalesce("b.term", "word").alias("spelled"))


def likest(names: DataFrame, titles: DataFrame, letters: int = 4) -> DataFrame:
    """(name, title, common): of each name the title with the longest common substring, ties to the first in order.

    Only titles that share a run of ``letters`` letters with the name are compared, since no shorter one counts.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - letters + 1), lambda k: F.substring(c, k, F.lit(letters))))
    cut = lambda df, c: df.select(c).filter(F.length(c) >= letters).distinct().select(c, F.explode(runs(F.col(c))).alias("k"))
    met = cut(names, "name").join(cut(titles, "title"), "k").select("name", "title").distinct()
    met = met.withColumn("common", S.longest_common(F.col("name"), F.col("title")))
    return met.groupBy("name").agg(F.min(F.struct((-F.col("common")).alias("m"), "title")).alias("b")).select("name", "b.title", (-F.col("b.m")).alias("common"))


def layer_of(texts: DataFrame, aliases: DataFrame, least: int = 2, share: float = 0.9, letters: int = 3) -> DataFrame:
    """(name, layer): the layer whose alias shares more than ``least`` letters in a row and more than ``share`` of the shorter."""
    best = likest(texts, aliases.select(F.col("alias").alias("title")), letters)
    good = best.filter((F.col("common") > least) & (F.col("common") > share * F.least(F.length("name"), F.length("title"))))
    return good.join(aliases.groupBy(F.col("alias").alias("title")).agg(F.min("layer").alias("layer")), "title").select("name", "layer")


def _topics(s, d) -> DataFrame:
    """Topic triples of the parts: each is below one of a third of its number, some are the same as the next."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_name", "p_size")
    uri = lambda k: F.concat(F.lit("http://topics.example/"), S.underscored(F.col("p_name")), F.lit("_%28t"), k.cast("string"), F.lit("%29"))
    q = p.select(F.col("k").alias("j"), F.concat(F.lit("http://topics.example/"), S.underscored(F.col("p_name")), F.lit("_%28t"), F.col("k").cast("string"), F.lit("%29")).alias("o"))
    named = p.select("k", "p_size", uri(F.col("k")).alias("s"))
    above = named.join(q, F.floor(named["k"] / 3) == q["j"]).select(F.col("o").alias("s"), F.lit("superTopicOf").alias("p"), F.col("s").alias("o"))
    same = named.filter("p_size % 5 = 0").join(q, named["k"] + 1 == q["j"]).select("s", F.lit("preferentialEquivalent").alias("p"), "o")
    return above.unionByName(same)


_TOPIC_SQL = """WITH n AS (SELECT p_partkey AS k, p_size, 'http://topics.example/' || replace(p_name, ' ', '_') || '_%28t' || p_partkey || '%29' AS uri, lower(p_name) AS label, 't' || p_partkey AS abbr FROM part),
t AS (SELECT b.uri AS s, 'superTopicOf' AS p, a.uri AS o FROM n a JOIN n b ON a.k // 3 = b.k UNION ALL SELECT a.uri, 'preferentialEquivalent', b.uri FROM n a JOIN n b ON a.p_size % 5 = 0 AND b.k = a.k + 1),
u AS (SELECT s AS uri FROM t UNION SELECT o FROM t), pref AS (SELECT s AS uri, min(o) AS best FROM t WHERE p = 'preferentialEquivalent' GROUP BY 1),
m AS (SELECT coalesce(best, u.uri) AS uri, label, abbr FROM u JOIN n ON n.uri = u.uri LEFT JOIN pref ON pref.uri = u.uri),
terms AS (SELECT term, min(uri) AS uri FROM (SELECT label AS term, uri FROM m UNION ALL SELECT abbr, uri FROM m) GROUP BY 1)"""


def queries() -> dict:
    lines = lambda s, d: table(s, d, "lineitem")

    def annotations(s, d):
        e = lines(s, d).select(F.col("l_orderkey").cast("string").alias("doc"), F.concat(F.lit("T"), "l_linenumber").alias("id"), "l_partkey").groupBy("doc", "id").agg(F.min("l_partkey").alias("k"))
        return e.join(table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("text")), "k").select("doc", "id", "text")

    def relations(s, d):
        kind = F.element_at(F.array(*map(F.lit, ("Used-for", "Part_of", "Coref"))), F.pmod("l_linenumber", F.lit(3)) + 1)
        return lines(s, d).select(F.col("l_orderkey").cast("string").alias("doc"), kind.alias("rel"), F.concat(F.lit("T"), "l_linenumber").alias("arg1"), F.concat(F.lit("T"), F.col("l_linenumber") + 1).alias("arg2")).distinct()

    def equal_terms(s, d):
        return table(s, d, "part").filter("p_size % 2 = 0").select(F.concat(F.lit("w"), "p_partkey").alias("src"), F.concat(F.lit("w"), F.col("p_partkey") + 7).alias("dst"))

    def known(s, d):
        return table(s, d, "part").filter("p_size % 3 = 0").select(F.concat(F.lit("w"), "p_partkey").alias("term"), F.concat(F.lit("uri/"), "p_brand").alias("uri"))

    def words(s, d):
        return table(s, d, "entity").select(F.explode(F.split(F.lower("entitytext"), " ")).alias("word")).filter("length(word) > 3 and length(word) < 16 and word rlike '^[a-z]+$'")

    def dictionary(s, d):
        t = table(s, d, "layer_type_stardard").select(F.explode(F.split(F.lower("layer_type"), " ")).alias("term"), F.lit(0).alias("rank"))
        g = table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("term"), F.lit(1).alias("rank"))
        return t.unionByName(g).filter("length(term) > 3").groupBy("term").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))

    nations = lambda s, d: table(s, d, "nation").select(F.lower("n_name").alias("name"))
    kinds = lambda s, d: table(s, d, "part").select(F.lower("p_type").alias("title")).distinct()
    return {
        "topic_terms": lambda s, d: topic_terms(_topics(s, d)),
        "topic_relations": lambda s, d: topic_relations(_topics(s, d)),
        "equivalence_sets": lambda s, d: equivalence_sets(topic_terms(_topics(s, d))).select("uri", F.array_join("terms", "|").alias("terms")),
        "resolved_relations": lambda s, d: resolved(table(s, d, "part").select(F.concat(F.lit("t"), "p_partkey").alias("a"), F.lit("uses").alias("rel"), F.concat(F.lit("t"), F.col("p_partkey") * 2).alias("b")), topic_terms(_topics(s, d))),
        "relation_texts": lambda s, d: relation_texts(relations(s, d), annotations(s, d)),
        "remapped_relations": lambda s, d: remapped(relations(s, d), "rel"),
        "same_as_terms": lambda s, d: same_as_terms(equal_terms(s, d), known(s, d))[0],
        "same_as_conflicts": lambda s, d: same_as_terms(equal_terms(s, d), known(s, d))[1],
        "spelled_words": lambda s, d: spelled(words(s, d), dictionary(s, d)),
        "likest_titles": lambda s, d: likest(nations(s, d), kinds(s, d), 2),
        "abbreviations": lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.substring("p_name", 1, 1), F.substring(F.element_at(F.split("p_name", " "), -1), 1, 1)).alias("short"), "p_name").select("p_partkey", S.abbreviates(F.col("short"), F.col("p_name")).alias("yes"), S.abbreviates(F.reverse("short"), F.col("p_name")).alias("turned")),
        "file_stems": lambda s, d: table(s, d, "paper").filter("paper_link is not null").select("paper_id", S.file_stem(F.col("paper_link")).alias("stem")),
        "archive_links": lambda s, d: table(s, d, "paper").filter("code is not null").select("paper_id", S.archive_link(F.col("code")).alias("link")),
        "scanned_words": lambda s, d: table(s, d, "entity").filter("entitytext is not null").select("entity_id", S.scanned_words(F.col("entitytext")).alias("words")).distinct(),
        "tagged_entities": lambda s, d: table(s, d, "part").select("p_partkey", F.concat(F.lit("<e1>"), F.element_at(F.split("p_name", " "), 1), F.lit("</e1> <e2>"), F.element_at(F.split("p_name", " "), -1), F.lit("</e2>")).alias("t")).select("p_partkey", S.tagged(F.col("t"), "e1").alias("e1"), S.tagged(F.col("t"), "e2").alias("e2")),
        "kept_words": lambda s, d: table(s, d, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set(F.element_at(F.split("p_name", " "), 1))).alias("w")).select("p_brand", F.array_join(S.kept_words(F.col("w")), " ").alias("words")),
    }


def oracle_sql() -> dict[str, str]:
    ann = "e AS (SELECT CAST(l_orderkey AS VARCHAR) AS doc, 'T' || l_linenumber AS id, min(l_partkey) AS k FROM lineitem GROUP BY 1, 2), a AS (SELECT doc, id, p_name AS text FROM e JOIN part ON k = p_partkey)"
    rel = "r AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS doc, ['Used-for', 'Part_of', 'Coref'][l_linenumber % 3 + 1] AS rel, 'T' || l_linenumber AS arg1, 'T' || (l_linenumber + 1) AS arg2 FROM lineitem)"
    same = "WITH RECURSIVE p AS (SELECT 'w' || p_partkey AS a, 'w' || (p_partkey + 7) AS b FROM part WHERE p_size % 2 = 0), q AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, a AS seen FROM q UNION SELECT r.node, q.b FROM r JOIN q ON r.seen = q.a), c AS (SELECT node AS term, min(seen) AS component FROM r GROUP BY 1), k AS (SELECT 'w' || p_partkey AS term, 'uri/' || p_brand AS uri FROM part WHERE p_size % 3 = 0), m AS (SELECT * FROM c LEFT JOIN k USING (term)), h AS (SELECT component, arg_min(uri, term) AS chosen FROM m WHERE uri IS NOT NULL GROUP BY 1)"
    spell = "WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(entitytext), ' ')) AS word FROM entity) WHERE length(word) > 3 AND length(word) < 16 AND regexp_full_match(word, '[a-z]+')), t AS (SELECT term, min(rank) AS rank, count(*) AS n FROM (SELECT unnest(string_split(lower(layer_type), ' ')) AS term, 0 AS rank FROM layer_type_stardard UNION ALL SELECT unnest(string_split(p_name, ' ')), 1 FROM part) WHERE length(term) > 3 GROUP BY 1), x AS (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY rank, levenshtein(word, term), n DESC, term) AS rn FROM w JOIN t ON levenshtein(word, term) <= 2) SELECT word, coalesce(term, word) AS spelled FROM w LEFT JOIN (SELECT * FROM x WHERE rn = 1) USING (word)"
    like = "WITH a AS (SELECT lower(n_name) AS name FROM nation), b AS (SELECT DISTINCT lower(p_type) AS title FROM part), sub AS (SELECT name, substr(name, CAST(i AS INTEGER), CAST(k AS INTEGER)) AS x, k FROM a, range(1, 30) t(i), range(2, 30) u(k) WHERE i + k - 1 <= length(name)), c AS (SELECT name, title, max(k) AS common FROM sub JOIN b ON contains(title, x) GROUP BY 1, 2) SELECT name, title, CAST(common AS INTEGER) AS common FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY common DESC, title) AS rn FROM c) WHERE rn = 1"
    return {
        "topic_terms": f"{_TOPIC_SQL} SELECT term, uri FROM terms",
        "topic_relations": f"{_TOPIC_SQL} SELECT DISTINCT coalesce(y.best, t.o) AS src, 'isA' AS rel, coalesce(x.best, t.s) AS dst FROM t LEFT JOIN pref x ON x.uri = t.s LEFT JOIN pref y ON y.uri = t.o WHERE t.p = 'superTopicOf'",
        "equivalence_sets": f"{_TOPIC_SQL} SELECT uri, string_agg(term, '|' ORDER BY term) AS terms FROM terms GROUP BY uri",
        "resolved_relations": f"{_TOPIC_SQL} SELECT DISTINCT a.uri AS src, 'uses' AS rel, b.uri AS dst FROM part JOIN terms a ON a.term = 't' || p_partkey JOIN terms b ON b.term = 't' || (p_partkey * 2)",
        "relation_texts": f"WITH {ann}, {rel} SELECT r.doc, x.text || '--' || y.text AS pair, rel FROM r JOIN a x ON x.doc = r.doc AND x.id = arg1 JOIN a y ON y.doc = r.doc AND y.id = arg2",
        "remapped_relations": f"WITH {rel} SELECT doc, CASE rel WHEN 'Used-for' THEN 'Used For' ELSE 'Part Of' END AS rel, arg1, arg2 FROM r WHERE rel <> 'Coref'",
        "same_as_terms": f"{same} SELECT term, coalesce(uri, chosen) AS uri FROM m JOIN h USING (component)",
        "same_as_conflicts": f"{same} SELECT component, term, uri, chosen FROM m JOIN h USING (component) WHERE uri <> chosen",
        "spelled_words": spell,
        "likest_titles": like,
        "abbreviations": "WITH a AS (SELECT p_partkey, p_name, substr(p_name, 1, 1) AS x, substr(split_part(p_name, ' ', -1), 1, 1) AS y FROM part) SELECT p_partkey, CASE WHEN y = 's' THEN x <> 's' ELSE regexp_matches(p_name, '^' || x || '(?:|.*\\W)' || y) END AS yes, CASE WHEN x = 's' THEN y <> 's' AND starts_with(p_name, y) ELSE regexp_matches(p_name, '^' || y || '(?:|.*\\W)' || x) END AS turned FROM a",
        "file_stems": "SELECT paper_id, regexp_replace(split_part(paper_link, '/', -1), '\\.(pdf|html)$', '') AS stem FROM paper WHERE paper_link IS NOT NULL",
        "archive_links": "SELECT paper_id, regexp_replace(regexp_replace(regexp_replace(code, '[?#].*$', ''), '/+$', ''), '\\.git$', '') || '/archive/master.zip' AS link FROM paper WHERE code IS NOT NULL",
        "scanned_words": "SELECT DISTINCT entity_id, trim(regexp_replace(regexp_replace(entitytext, '[^\\x20-\\x7e]', '', 'g'), '[^0-9A-Za-z_]+', ' ', 'g'), ' ') AS words FROM entity WHERE entitytext IS NOT NULL",
        "tagged_entities": "SELECT p_partkey, split_part(p_name, ' ', 1) AS e1, split_part(p_name, ' ', -1) AS e2 FROM part",
        "kept_words": "WITH w AS (SELECT DISTINCT p_brand, split_part(p_name, ' ', 1) AS w FROM part) SELECT p_brand, string_agg(w, ' ' ORDER BY w) AS words FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.p_brand = a.p_brand AND b.w < a.w AND (contains(a.w, b.w) OR contains(b.w, a.w))) GROUP BY p_brand",
    }
