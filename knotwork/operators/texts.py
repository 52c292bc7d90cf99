"""Text operators: TF-IDF of node labels, dictionary annotation, standoff annotations, abbreviations, names."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.session import stage_table, table


def words(c: Column) -> Column:
    """Lower-case words of two characters or more."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 1) -> DataFrame:
    """(key, term, weight): counts times smooth inverse document frequency, each document to unit length.

    Term counts are aggregated per document once and written; document frequencies are joined back by term.
    """
    counts = stage_table(docs.select(key, F.explode(words(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")), "counts")
    n = docs.count()
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    raw = counts.join(df, "term").withColumn("w", F.col("tf") * (F.ln((1 + F.lit(n)) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.select(key, "term", F.round(F.col("w") / norm, 6).alias("weight"))


def sentences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sent_id, start, end, sentence): sentences with their place in the text, the end after the last letter.

    A sentence ends at ``.``, ``!`` or ``?`` before a blank. Each text is cut once where it lies, in time of its length.
    """
    kind = dict(docs.dtypes)[key]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        gap = re.compile(r"(?<=[.!?])[ \t\n\x0b\f\r]")
        for b in batches:
            keys, ids, starts, ends, texts = [], [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                at = 0
                for n, part in enumerate(gap.split(t)):
                    keys.append(k)
                    ids.append(n)
                    starts.append(at)
                    ends.append(at + len(part))
                    texts.append(part)
                    at += len(part) + 1
            ints = [pa.array(x, pa.int32()) for x in (ids, starts, ends)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), *ints, pa.array(texts, pa.string())], [key, "sent_id", "start", "end", "sentence"])

    return docs.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(cut, f"{key} {kind}, sent_id int, start int, end int, sentence string")


def annotations_in_sentences(marks: DataFrame, sents: DataFrame, key: str, width: int = 256) -> DataFrame:
    """Annotations with the sentence in which they begin, both ends included, by an equi-join on blocks of places."""
    s = sents.select(key, "sent_id", "start", "end").withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    a = marks.withColumn("_b", F.floor(F.col("begin") / width))
    return a.join(s, [key, "_b"]).filter(F.col("begin").between(F.col("start"), F.col("end"))).drop("_b")


def relations_within(relations: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """Relations whose two annotations stand in one sentence."""
    side = lambda arg: placed.select(key, F.col("id").alias(arg), F.col("sent_id").alias(f"_{arg}"))
    return relations.join(side("arg1"), [key, "arg1"]).join(side("arg2"), [key, "arg2"]).filter("_arg1 = _arg2").drop("_arg2").withColumnRenamed("_arg1", "sent_id")


def keep_outer(spans: list[tuple[int, int, int, int]]) -> list[int]:
    """Ids of spans (id, start, end, length) that stay: sorted by place, an earlier one of equal start goes, contained ones go."""
    rows = sorted(spans, key=lambda r: (r[1], r[2], r[3]))
    gone: set[int] = set()
    for i, a in enumerate(rows):
        if a[0] in gone:
            continue
        for b in rows[i + 1 :]:
            if b[1] >= a[2]:
                break
            if b[1] == a[1]:
                gone.add(a[0])
                break
            if b[2] <= a[2]:
                gone.add(b[0])
    return [r[0] for r in rows if r[0] not in gone]


#: Forms of a dictionary that is sent to the tasks.
MOST_TERMS = 500_000


def _annotated(rows: Broadcast):
    """Task that finds the terms of (term, uri) rows in texts by their first words and resolves overlaps per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word, edge = re.compile(r"\w+"), re.compile(r"\w")
        free = lambda t, k: not 0 <= k < len(t) or not edge.match(t[k])
        under: dict[str, list[tuple[int, str, str]]] = {}
        bare = []
        for term, uri in rows.value:
            m = word.search(term)
            if m:
                under.setdefault(m[0], []).append((m.start(), term, uri))
            elif term:
                bare.append((term, uri))
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = set()
                for m in word.finditer(t):
                    for lead, term, uri in under.get(m[0], ()):
                        a = m.start() - lead
                        if a >= 0 and t.startswith(term, a) and free(t, a - 1) and free(t, a + len(term)):
                            found.add((a, a + len(term), term, uri))
                for term, uri in bare:
                    a = t.find(term)
                    while a >= 0:
                        if free(t, a - 1) and free(t, a + len(term)):
                            found.add((a, a + len(term), term, uri))
                        a = t.find(term, a + 1)
                spans = sorted(found)
                out += [(k, *spans[i]) for i in keep_outer([(n, r[0], r[1], r[1] - r[0]) for n, r in enumerate(spans)])]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (b.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["key", "start", "end", "text", "uri"])

    return run


def annotate(docs: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, end, text, uri): dictionary terms found in texts, an ``s`` more allowed, overlaps resolved.

    A dictionary of up to ``MOST_TERMS`` forms goes to the tasks under the first words of its terms, and each text is annotated
    where it lies, without a shuffle. For a longer one, every run of up to as many words as the longest term has, with the non-word characters that terms
    begin and end with, is a candidate and is joined to the dictionary by equality, so no text meets a term that it does
    not have. A term needs a non-word character on both sides; the text is padded, so terms at its ends count too.
    """

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for b in batches:
            out = set()
            for t in filter(None, b.column(0).to_pylist()):
                n = len(re.findall(r"\w+", t))
                out.add((n, re.match(r"\W*", t)[0], re.search(r"\W*\Z", t)[0] if n else ""))
            cols = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.string()), strict=True)], ["words", "lead", "trail"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        word, edge = re.compile(r"\w+"), re.compile(r"\w")
        free = lambda t, k: not 0 <= k < len(t) or not edge.match(t[k])
        for b in batches:
            keys, starts, ends, terms = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                spans = [m.span() for m in word.finditer(t)]
                begins = [[a - len(x) for x in leads if t.endswith(x, 0, a) and free(t, a - len(x) - 1)] for a, _ in spans]
                stops = [[e + len(x) for x in trails if t.startswith(x, e) and free(t, e + len(x))] for _, e in spans]
                runs = [(a, e) for i in range(len(spans)) for a in begins[i] for j in range(i, min(i + longest, len(spans))) for e in stops[j]]
                for x in bare:  # terms without a word
                    a = t.find(x)
                    while a >= 0:
                        if free(t, a - 1) and free(t, a + len(x)):
                            runs.append((a, a + len(x)))
                        a = t.find(x, a + 1)
                for a, e in runs:
                    keys.append(k)
                    starts.append(a)
                    ends.append(e)
                    terms.append(t[a:e])
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.column(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(terms, pa.string())], ["key", "start", "end", "text"])

    kind = dict(docs.dtypes)[key]
    terms = dictionary.select(F.lower("term").alias("term"), "uri")
    plural = terms.select(F.concat("term", F.lit("s")).alias("term"), "uri")
    forms = terms.unionByName(plural).groupBy("term").agg(F.min("uri").alias("uri"))
    texts = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.lower(text).alias("t"))
    listed = forms.limit(MOST_TERMS + 1).collect()
    if len(listed) <= MOST_TERMS:
        rows = docs.sparkSession.sparkContext.broadcast([(r["term"], r["uri"]) for r in listed])
        return texts.mapInArrow(_annotated(rows), f"key {kind}, start int, end int, text string, uri string").withColumnRenamed("key", key)
    found = forms.select("term").mapInArrow(shapes, "words int, lead string, trail string").groupBy("lead", "trail", F.col("words") > 0).agg(F.max("words").alias("words")).collect()
    longest = max((x.words for x in found), default=0)
    leads, trails = sorted({x.lead for x in found if x.words}), sorted({x.trail for x in found if x.words})
    bare = sorted({x.lead for x in found if not x.words})
    found = texts.mapInArrow(grams, f"key {kind}, start int, end int, text string").join(forms.withColumnRenamed("term", "text"), "text")
    spans = found.groupBy("key").agg(F.collect_list(F.struct("start", "end", "text", "uri")).alias("s"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, s in zip(b.column("key").to_pylist(), b.column("s").to_pylist(), strict=True):
                rows = sorted((x["start"], x["end"], x["text"], x["uri"]) for x in s)
                for i in keep_outer([(n, r[0], r[1], r[1] - r[0]) for n, r in enumerate(rows)]):
                    out.append((k, *rows[i]))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (b.column("key").type, pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["key", "start", "end", "text", "uri"])

    out = spans.mapInArrow(clean, f"key {kind}, start int, end int, text string, uri string")
    return out.withColumnRenamed("key", key)


def related_pairs(marks: DataFrame, relations: DataFrame, key: str) -> DataFrame:
    """(key, start_a, start_b, rel): pairs of annotations in order with their known relation, ``sameAs`` for equal uris.

    Distinct uris per text are joined through the relation table, so pairs without a relation are never made.
    """
    a = marks.select(key, F.col("start").alias("start_a"), F.col("uri").alias("uri_a"))
    b = marks.select(key, F.col("start").alias("start_b"), F.col("uri").alias("uri_b"))
    known = a.join(relations.select("uri_a", "uri_b", "rel"), "uri_a").join(b, [key, "uri_b"]).filter("start_a < start_b and uri_a <> uri_b")
    w = Window.partitionBy(key, "uri_a").orderBy("start_a")
    # equal uris are chained to the next one instead of all pairs
    same = a.withColumn("start_b", F.lead("start_a").over(w)).filter("start_b is not null").select(key, "start_a", "start_b", F.lit("sameAs").alias("rel"))
    return known.select(key, "start_a", "start_b", "rel").unionByName(same)


def name_tokens(c: Column) -> Column:
    """Sub-tokens of an identifier, split at case changes, underscores and digits, in lower case, each once."""
    parts = F.split(c, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_|[0-9]|\W+")
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.lower(x)))


# Openings that an entity name loses.
DROPPED = (r"^a", r"^the", "novel", "our", "proposed", "previous", "state-of-the-art", "their", "new")


def entity_name(c: Column) -> Column:
    """Entity text without articles and words of praise, trimmed and lower-cased."""
    for w in DROPPED:
        head, body = ("^", w[1:]) if w.startswith("^") else ("", w)
        c = F.regexp_replace(c, rf"{head}\b{body}\b", "")
    return F.lower(F.trim(c))


def semeval_line(c: Column, s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Text with its two entities marked, offsets counted from 0."""
    cut = lambda a, b: F.substring(c, a + 1, b - a)
    mark = lambda k, a, b: F.concat(F.lit(f"<e{k}>"), cut(a, b), F.lit(f"</e{k}>"))
    return F.when(s1 <= s2, F.concat(cut(F.lit(0), s1), mark(1, s1, e1), cut(e1, s2), mark(2, s2, e2), cut(e2, F.length(c)))).otherwise(F.concat(cut(F.lit(0), s2), mark(2, s2, e2), cut(e2, s1), mark(1, s1, e1), cut(e1, F.length(c))))


def queries() -> dict:
    short = lambda s, d: table(s, d, "documents").filter("text is not null").select("doc_id", "text")

    def marks(s, d):
        at = F.posexplode(F.split("text", "decoder"))
        e = short(s, d).select("doc_id", F.split("text", "decoder").alias("p"), at.alias("k", "x")).filter("k > 0")
        begin = F.aggregate(F.slice("p", 1, F.col("k")), F.lit(0), lambda a, x: a + F.length(x)) + (F.col("k") - 1) * 7
        return e.select("doc_id", begin.alias("begin"))

    def branded(s, d):
        b = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("uri"))
        return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("start"), "l_partkey").distinct().join(b, "l_partkey").select("doc", "start", "uri").distinct()

    def brand_relations(s, d):
        p = table(s, d, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_size")
        q = p.select((F.col("k") - 1).alias("k"), F.col("p_brand").alias("uri_b"))
        return p.filter("p_size = 10").join(q, "k").groupBy(F.col("p_brand").alias("uri_a"), "uri_b").agg(F.lit("uses").alias("rel"))

    def arguments(s, d):
        return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit("uses").alias("rel"), F.col("l_linenumber").alias("arg1"), (F.col("l_linenumber") + 1).alias("arg2")).distinct()

    def placed(s, d):
        return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("id"), F.floor(F.col("l_linenumber") / 3).alias("sent_id")).distinct()

    return {
        "tfidf_node_features": lambda s, d: tfidf(table(s, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t")), "p_partkey", "t"),
        "sentence_range_join": lambda s, d: annotations_in_sentences(marks(s, d), sentences(short(s, d), "doc_id", "text"), "doc_id").select("doc_id", "begin", "sent_id"),
        "sentence_split": lambda s, d: sentences(short(s, d), "doc_id", "text"),
        "related_pairs": lambda s, d: related_pairs(branded(s, d), brand_relations(s, d), "doc"),
        "relations_within": lambda s, d: relations_within(arguments(s, d), placed(s, d), "doc"),
        "dictionary_annotation": lambda s, d: annotate(short(s, d), table(s, d, "layer_type_stardard").select(F.col("variant").alias("term"), F.concat(F.lit("layer/"), F.replace("layer_type", F.lit(" "), F.lit("_"))).alias("uri")).union(s.createDataFrame([("hit rate", "metric/hit_rate"), ("rank loss", "metric/rank_loss"), ("decoder", "method/decoder"), ("loss", "method/loss")], "term string, uri string")), "doc_id", "text"),
        "name_subtokens": lambda s, d: table(s, d, "repo").filter("code_path is not null").select("file_id", F.concat_ws(" ", name_tokens(F.regexp_extract("code_path", r"([^/]+)\.\w+$", 1))).alias("tokens")),
        "entity_names": lambda s, d: table(s, d, "entity").filter("entitytext is not null").select("entity_id", entity_name(F.col("entitytext")).alias("name")).distinct(),
        "semeval_lines": lambda s, d: table(s, d, "part").select("p_partkey", semeval_line(F.col("p_name"), F.lit(0), F.instr("p_name", " ") - 1, F.instr("p_name", " "), F.length("p_name")).alias("line")),
    }


def oracle_sql() -> dict[str, str]:
    parts = "WITH t AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
    return {
        "tfidf_node_features": "WITH d AS (SELECT p_partkey, lower(concat_ws(' ', p_name, p_type, p_brand)) AS t FROM part), c AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(regexp_extract_all(t, '\\b\\w\\w+\\b')) AS term FROM d) GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1), w AS (SELECT p_partkey, term, tf * (ln((1 + (SELECT count(*) FROM d)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term)) SELECT p_partkey, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS weight FROM w",
        "semeval_lines": "SELECT p_partkey, '<e1>' || split_part(p_name, ' ', 1) || '</e1> <e2>' || substr(p_name, instr(p_name, ' ') + 1) || '</e2>' AS line FROM part",
        "entity_names": "SELECT DISTINCT entity_id, lower(trim(" + _drop_sql() + ", ' ')) AS name FROM entity WHERE entitytext IS NOT NULL",
        "sentence_range_join": parts + ", m AS (SELECT doc_id, text, string_split(text, 'decoder') AS p, unnest(range(1, len(string_split(text, 'decoder')))) AS k FROM t), b AS (SELECT doc_id, text, CAST(length(array_to_string(p[1:k], 'decoder')) AS INTEGER) AS begin FROM m) SELECT doc_id, begin, CAST(len(regexp_extract_all(substr(text, 1, begin), '[.!?]\\s')) AS INTEGER) AS sent_id FROM b",
        "sentence_split": parts + ", p AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t\\n\\x0b\\f\\r]', '\\1' || chr(1), 'g'), chr(1)) AS p FROM t), q AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS k, p FROM p) SELECT doc_id, CAST(k - 1 AS INTEGER) AS sent_id, CAST(coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length(x) + 1)), 0) AS INTEGER) AS start, CAST(coalesce(list_sum(list_transform(p[1:k - 1], lambda x: length(x) + 1)), 0) + length(p[k]) AS INTEGER) AS \"end\", p[k] AS sentence FROM q",
        "related_pairs": "WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS start, p_brand AS uri FROM lineitem JOIN part ON l_partkey = p_partkey), r AS (SELECT DISTINCT a.p_brand AS uri_a, b.p_brand AS uri_b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size = 10) SELECT a.doc, a.start AS start_a, b.start AS start_b, 'uses' AS rel FROM m a JOIN m b ON a.doc = b.doc AND a.start < b.start AND a.uri <> b.uri JOIN r ON r.uri_a = a.uri AND r.uri_b = b.uri UNION ALL SELECT doc, start, nxt, 'sameAs' FROM (SELECT doc, start, lead(start) OVER (PARTITION BY doc, uri ORDER BY start) AS nxt FROM m) WHERE nxt IS NOT NULL",
        "relations_within": "WITH m AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS id FROM lineitem) SELECT a.doc, 'uses' AS rel, a.id AS arg1, b.id AS arg2, CAST(a.id // 3 AS BIGINT) AS sent_id FROM m a JOIN m b ON a.doc = b.doc AND b.id = a.id + 1 AND a.id // 3 = b.id // 3",
        "name_subtokens": "WITH n AS (SELECT file_id, regexp_extract(code_path, '([^/]+)\\.\\w+$', 1) AS n FROM repo WHERE code_path IS NOT NULL), s AS (SELECT file_id, string_split_regex(regexp_replace(regexp_replace(n, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_|[0-9]|[^0-9A-Za-z_]+') AS p FROM n), u AS (SELECT file_id, lower(p[k]) AS w, min(k) AS k FROM s, range(1, 60) t(k) WHERE k <= len(p) AND p[k] <> '' GROUP BY 1, 2) SELECT file_id, coalesce(w, '') AS tokens FROM n LEFT JOIN (SELECT file_id, string_agg(w, ' ' ORDER BY k) AS w FROM u GROUP BY 1) USING (file_id)",
    }


def _drop_sql() -> str:
    out = "entitytext"
    for w in DROPPED:
        head, body = ("^", w[1:]) if w.startswith("^") else ("", w)
        out = f"regexp_replace({out}, '{head}\\b{body}\\b', '', 'g')"
    return out
