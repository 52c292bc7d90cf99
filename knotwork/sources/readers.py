"""Readers of the file kinds that facts come from: RDF, triple lines, figures, standoff files, TEI, metadata folders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork import schema
from knotwork.operators.sampling import numbered
from knotwork.operators.tabular import last_written, metadata_record

_NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*")(?:\^\^<([^>]*)>|@([A-Za-z][A-Za-z0-9-]*))?\s*\.'


def _unescape(c):
    for a, b in ((r"\\t", "\t"), (r"\\n", "\n"), (r"\\r", "\r"), (r"\\\"", '"'), (r"\\\\", r"\\")):
        c = F.regexp_replace(c, a, b)
    return c


def ntriples(spark: SparkSession, path: str, graph: str = "") -> DataFrame:
    """Triples of N-Triples files; comments and broken lines give none, repeated lines one."""
    line = F.col("value")
    part = lambda k: F.regexp_extract(line, _NT, k)
    rows = spark.read.text(path).filter(F.rlike(line, F.lit(_NT)))
    kind = lambda t: F.when(F.startswith(t, F.lit("<")), "uri").when(F.startswith(t, F.lit("_:")), "bnode").otherwise("literal")
    bare = lambda t: F.when(F.startswith(t, F.lit("<")), F.substring(t, 2, 1 << 30).substr(F.lit(1), F.length(t) - 2)).when(F.startswith(t, F.lit('"')), _unescape(t.substr(F.lit(2), F.length(t) - 2))).otherwise(t)
    out = rows.select(
        F.lit(graph).alias("graph"), bare(part(1)).alias("s"), kind(part(1)).alias("s_kind"), part(2).alias("p"), bare(part(3)).alias("o"), kind(part(3)).alias("o_kind"),
        F.nullif(part(4), F.lit("")).alias("o_datatype"), F.nullif(part(5), F.lit("")).alias("o_lang"),
    )
    return out.distinct()


_TTL = re.compile(
    r'''\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>"""[\s\S]*?"""|\'\'\'[\s\S]*?\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][\w-]*)|(?P<type>\^\^)'''
    r"""|(?P<bnode>_:[\w.-]*\w)|(?P<name>(?:[A-Za-z][\w.-]*)?:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*)|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z]+)|(?P<op>[.;,\[\]()])"""
)


def parse_turtle(text: str) -> list[tuple]:
    """(s, s_kind, p, o, o_kind, datatype, lang) of a Turtle document: prefixes, base, ``a``, ``;``, ``,``, ``[]``, lists."""
    tokens = []
    at = 0
    while at < len(text):
        m = _TTL.match(text, at)
        if not m:
            raise ValueError(f"cannot read Turtle at {text[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
    names, base, out, k, blanks = {}, "", [], 0, 0
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    xsd = "http://www.w3.org/2001/XMLSchema#"

    def fresh() -> tuple:
        nonlocal blanks
        blanks += 1
        return (f"_:b{blanks}", "bnode", None, None)

    def term() -> tuple:
        nonlocal k
        kind, s = tokens[k]
        k += 1
        if kind == "iri":
            return (s[1:-1] if ":" in s else base + s[1:-1], "uri", None, None)
        if kind == "name":
            head, tail = s.split(":", 1)
            return (names.get(head, head + ":") + tail.replace("\\", ""), "uri", None, None)
        if kind == "bnode":
            return (s, "bnode", None, None)
        if kind == "word":
            return (rdf + "type", "uri", None, None) if s == "a" else (s, "literal", xsd + "boolean", None)
        if kind == "num":
            return (s, "literal", xsd + ("integer" if re.fullmatch(r"[+-]?\d+", s) else "double" if "e" in s.lower() else "decimal"), None)
        if kind == "text":
            n = 3 if s[:3] in ('"""', "'''") else 1
            value = re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), s[n:-n])
            kind_of = lang = None
            if k < len(tokens) and tokens[k][0] == "type":
                k += 1
                kind_of = term()[0]
            elif k < len(tokens) and tokens[k][0] == "lang":
                lang = tokens[k][1][1:]
                k += 1
            return (value, "literal", kind_of, lang)
        if s == "[":
            node = fresh()
            if tokens[k][1] != "]":
                predicates(node)
            k += 1
            return node
        if s == "(":
            items = []
            while tokens[k][1] != ")":
                items.append(term())
            k += 1
            rest = (rdf + "nil", "uri", None, None)
            for item in reversed(items):
                node = fresh()
                out.append((node[0], "bnode", rdf + "first", *item))
                out.append((node[0], "bnode", rdf + "rest", *rest))
                rest = node
            return rest
        raise ValueError(f"unexpected {s!r} in Turtle")

    def predicates(subject: tuple) -> None:
        nonlocal k
        while tokens[k][1] not in (".", "]"):
            if tokens[k][1] == ";":
                k += 1
                continue
            p = term()[0]
            while True:
                out.append((subject[0], subject[1], p, *term()))
                if tokens[k][1] != ",":
                    break
                k += 1

    while k < len(tokens):
        kind, s = tokens[k]
        word = s.lower().lstrip("@")
        if kind in ("lang", "word") and word in ("prefix", "base"):
            k += 1
            if word == "prefix":
                names[tokens[k][1].rstrip(":")] = tokens[k + 1][1][1:-1]
                k += 1
            else:
                base = tokens[k][1][1:-1]
            k += 1
            if k < len(tokens) and tokens[k][1] == "." and s.startswith("@"):
                k += 1
            continue
        predicates(term())
        k += 1
    return out


def _turtle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            # blank nodes are local to their file
            local = lambda t, kind, path=path: f"{t}@{path}" if kind == "bnode" else t
            rows += [("", local(s, sk), sk, p, local(o, ok), ok, dt, lang) for s, sk, p, o, ok, dt, lang in parse_turtle(text)]
        names = [f.name for f in schema.TRIPLE.fields]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(len(names))], names)


def turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files, one file a task at the least; a triple that several files hold is one."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(_turtle_task, schema.TRIPLE).distinct()


def _rdf_nodes(root, rows: list[tuple], file: int) -> None:
    """Triples of the nodes of an RDF/XML document, nodes within properties and collections included."""
    rdf = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
    ns = rdf[1:-1]
    full = lambda tag: tag[1:].replace("}", "") if tag[0] == "{" else tag
    number = iter(range(1 << 62))
    blank = lambda: f"_:f{file}n{next(number)}"

    def node(e) -> tuple[str, str]:
        s = e.get(rdf + "about") or (f"#{e.get(rdf + 'ID')}" if e.get(rdf + "ID") else None) or (f"_:{e.get(rdf + 'nodeID')}" if e.get(rdf + "nodeID") else None)
        kind = "bnode" if s is None or s.startswith("_:") else "uri"
        s = s or blank()
        if e.tag != rdf + "Description":
            rows.append((s, ns + "type", full(e.tag), "uri"))
        for k, v in e.attrib.items():
            if not k.startswith((rdf, "{http://www.w3.org/XML/1998/namespace}")):
                rows.append((s, full(k), v, "literal"))
        for child in e:
            p = full(child.tag)
            below = list(child)
            if child.get(rdf + "resource") is not None:
                rows.append((s, p, child.get(rdf + "resource"), "uri"))
            elif child.get(rdf + "nodeID") is not None:
                rows.append((s, p, f"_:{child.get(rdf + 'nodeID')}", "bnode"))
            elif child.get(rdf + "parseType") == "Collection":
                cells = [blank() for _ in below]
                rows.append((s, p, cells[0] if cells else ns + "nil", "bnode" if cells else "uri"))
                for k, x in enumerate(below):
                    o, o_kind = node(x)
                    rows.append((cells[k], ns + "first", o, o_kind))
                    rows.append((cells[k], ns + "rest", cells[k + 1] if k + 1 < len(cells) else ns + "nil", "bnode" if k + 1 < len(cells) else "uri"))
            elif below:
                for x in below:
                    o, o_kind = node(x)
                    rows.append((s, p, o, o_kind))
            else:
                rows.append((s, p, child.text or "", "literal"))
        return s, kind

    for e in root:
        node(e)


def rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, o_kind) of RDF/XML and OWL files: described nodes, nodes nested in properties, collections.

    Nodes without a name get one that tells the file and the place; a file that is no XML gives nothing.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.etree import ElementTree
        from zlib import crc32

        for b in batches:
            rows: list[tuple] = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    _rdf_nodes(ElementTree.fromstring(text), rows, crc32(file.encode()))
                except ElementTree.ParseError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["s", "p", "o", "o_kind"])

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(task, "s string, p string, o string, o_kind string").distinct()


def triple_lines(spark: SparkSession, path: str, sep: str = "\t", prefix: str = "") -> DataFrame:
    """(paper, s, p, o) of lines with exactly three fields; the paper is the folder of the file, ``prefix`` is taken off."""
    line = F.trim(F.replace(F.col("value"), F.lit(prefix), F.lit(""))) if prefix else F.trim("value")
    rows = spark.read.text(path).select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("paper"), F.split(line, sep).alias("f"))
    return rows.filter(F.size("f") == 3).select("paper", F.col("f")[0].alias("s"), F.col("f")[1].alias("p"), F.col("f")[2].alias("o"))


def figure_lines(spark: SparkSession, path: str) -> DataFrame:
    """(paper, s, p, o) of figure graphs: blank-separated, in Latin 1, the object with all its words; the paper is three folders up."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.explode(F.split(F.decode("content", "ISO-8859-1"), r"\r?\n")).alias("value"))
    rows = rows.select(F.element_at(F.split("path", "/"), -3).alias("paper"), F.split(F.trim("value"), " ", 3).alias("f"))
    return rows.filter(F.size("f") == 3).select("paper", F.col("f")[0].alias("s"), F.col("f")[1].alias("p"), F.col("f")[2].alias("o"))


def csv(spark: SparkSession, path: str, kind=None, sep: str = ",", header: bool = True) -> DataFrame:
    """A table with a given schema; without one all columns are strings, nothing is inferred."""
    reader = spark.read.option("header", header).option("sep", sep).option("multiLine", False)
    return (reader.schema(kind) if kind is not None else reader).csv(path)


def csv_fields(line: Column, sep: str = ",") -> Column:
    """Fields of a line of separated values; in quotes a separator counts for nothing and two quotes are one."""
    cell = F.regexp_extract_all(line, F.lit(rf'("(?:[^"]|"")*"|[^{sep}]*)(?:{sep}|$)'), F.lit(1))
    # the expression also meets the empty end of the line, unless the line ends in a separator
    cell = F.when(F.endswith(line, F.lit(sep)), cell).otherwise(F.slice(cell, F.lit(1), F.greatest(F.size(cell) - 1, F.lit(1))))
    bare = lambda x: F.when(F.startswith(x, F.lit('"')), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    return F.transform(cell, lambda x: F.trim(bare(F.trim(x))))


def label_map(spark: SparkSession, path: str, key: int = 0, value: int = -1) -> DataFrame:
    """(key, value) of separated files that may begin with a byte order mark, by position of the columns.

    Of a repeated key the last line of the last file, by name, counts; commas in quotes do not part fields.
    """
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.regexp_replace("value", "^\ufeff", ""), r"\r?\n")).alias("n", "v"))
    fields = csv_fields(F.col("v"))
    at = lambda k: F.try_element_at(fields, F.lit(k + 1 if k >= 0 else k))
    rows = rows.filter("v <> ''").select(at(key).alias("key"), at(value).alias("value"), "path", "n").filter("key <> ''")
    return last_written(rows, ["key"], ["path", "n"]).select("key", "value")


def positional_csv(spark: SparkSession, path: str, sep: str = ",", skip: int = 1) -> DataFrame:
    """(path, line, fields) of separated files whose columns are told by position; the first ``skip`` lines of each are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "v"))
    return rows.filter((F.col("line") >= skip) & (F.col("v") != "")).select("path", "line", csv_fields(F.col("v"), sep).alias("fields"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of files, in lower case."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.lower("value").alias("text"))


def binary_slot(spark: SparkSession, path: str, read, kind: str, pattern: str = "*.pdf") -> DataFrame:
    """Rows of ``kind`` (a DDL string) that a function makes of each binary file, and its error as text.

    ``read(path, content)`` yields tuples; it stands for readers that are no part of this repository (pages of a PDF, boxes or
    a class of a picture). A file on which it fails gives one row with nulls and the error; the others are not touched.
    """
    names = [f.split()[0] for f in kind.split(", ")]

    def task(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out += [(p, None, *row) for row in read(p, bytes(content))]
                except Exception as e:  # noqa: BLE001
                    out.append((p, f"{type(e).__name__}: {e}", *[None] * len(names)))
            yield pd.DataFrame(out, columns=["path", "error", *names])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path).select("path", "content").mapInPandas(task, f"path string, error string, {kind}")


def standoff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of standoff annotation files; empty files and lines of other kinds give nothing."""
    doc = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.ann$", "")
    rows = spark.read.text(path).select(doc.alias("doc"), F.split("value", "\t").alias("f")).filter(F.size("f") >= 2)
    rows = rows.select("doc", F.col("f")[0].alias("id"), F.split(F.col("f")[1], " ").alias("g"), F.try_element_at("f", F.lit(3)).alias("text"))
    entities = rows.filter(F.startswith("id", F.lit("T")) & (F.size("g") >= 3)).select("doc", "id", F.col("g")[0].alias("type"), F.col("g")[1].try_cast("int").alias("start"), F.element_at("g", -1).try_cast("int").alias("end"), "text")
    arg = lambda k: F.element_at(F.split(F.col("g")[k], ":"), -1)
    relations = rows.filter(~F.startswith("id", F.lit("T")) & (F.size("g") == 3)).select("doc", "id", F.col("g")[0].alias("rel"), arg(1).alias("arg1"), arg(2).alias("arg2"))
    return entities, relations


TEI = "path string, title string, abstract string, doi string, authors array<string>, text string, sections array<string>, figures array<struct<head:string,caption:string>>"


def tei(spark: SparkSession, path: str, most_sections: int = 2) -> DataFrame:
    """One row per TEI document: title, abstract, doi, authors, text, its first sections, and figures as (head, caption).

    Every value is taken from its own element with all text below it, so an element without a part has a null there and
    no other is shifted. A file that is no XML gives no row.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xml.etree import ElementTree

        flat = lambda e: " ".join("".join(e.itertext()).split()) or None if e is not None else None
        figure = pa.list_(pa.struct([("head", pa.string()), ("caption", pa.string())]))
        kinds = [pa.string()] * 4 + [pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), figure]
        names = [f.split()[0] for f in TEI.split(", ")]
        for b in batches:
            rows = []
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    root = ElementTree.fromstring(re.sub(r'\sxmlns(:\w+)?="[^"]*"', "", text))
                except ElementTree.ParseError:
                    continue
                people = [" ".join(filter(None, (flat(p.find("forename")), flat(p.find("surname"))))) for p in root.iterfind(".//author/persName")]
                body = root.find(".//body")
                parts = [" ".join(filter(None, map(flat, d.iter("p")))) for d in (body.iterfind(".//div") if body is not None else ())]
                figures = [{"head": flat(f.find("head")), "caption": flat(f.find("figDesc"))} for f in root.iter("figure")]
                doi = next((flat(x) for x in root.iter("idno") if x.get("type") == "DOI"), None)
                rows.append((file, flat(root.find(".//titleStmt/title")), flat(root.find(".//abstract")), doi, list(dict.fromkeys(filter(None, people))), " ".join(filter(None, map(flat, body.iter("p")))) if body is not None else None, parts[:most_sections], figures))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInArrow(task, TEI)


def metadata_folder(spark: SparkSession, path: str) -> DataFrame:
    """One row per repository folder from its small text files; a missing file is null."""
    parts = F.split("_metadata.file_path", "/")
    rows = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = rows.select(F.element_at(parts, -2).alias("dir_name"), F.regexp_replace(F.element_at(parts, -1), r"\.txt$", "").alias("key"), "value")
    return metadata_record(rows)


def leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Tasks with their data sets and result rows from nested JSON."""
    kind = "categories array<string>, task string, datasets array<struct<dataset:string,sota:struct<sota_rows:array<struct<paper_url:string>>>>>"
    return spark.read.option("multiLine", True).schema(kind).json(path)


def figure_captions(spark: SparkSession, path: str, images: DataFrame) -> DataFrame:
    """(image, caption): the last figure whose rendered address holds the image's name as one of its parts.

    The address is cut at ``/``, ``?`` and ``=`` and every part is met by equality, with and without its ending.
    """
    figures = spark.read.option("multiLine", True).schema("caption string, imageText array<string>, renderURL string").json(path)
    figures = figures.select("caption", "renderURL", F.monotonically_increasing_id().alias("n"))
    parts = F.split("renderURL", "[/?=&]")
    held = figures.select("caption", "n", F.explode(F.array_distinct(F.concat(parts, F.transform(parts, lambda x: F.regexp_replace(x, r"\.\w+$", ""))))).alias("image"))
    return images.join(last_written(held.join(images.select("image").distinct(), "image", "left_semi"), ["image"], ["n"]).select("image", "caption"), "image", "left")


def repository(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """(path, code) of source files under a folder."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("code"))


def archives(spark: SparkSession, path: str, ending: str = ".py", encoding: str = "utf-8") -> DataFrame:
    """(archive, path, code) of the source files within zip archives; an archive that can't be opened gives nothing."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    inside = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                # one batch per archive, so a large one does not wait for others
                rows = [(file, name, inside.read(name).decode(encoding, "replace")) for name in inside.namelist() if name.endswith(ending)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["archive", "path", "code"])

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.zip").load(path)
    return rows.select("path", "content").mapInArrow(task, "archive string, path string, code string")


def path_context_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name, left, path, right) of context lines: a name, then blank-separated contexts of three parts; other parts are left out."""
    line = F.split("value", " ")
    rows = spark.read.text(path).select(line[0].alias("name"), F.explode(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0)))).alias("c")).select("name", F.split("c", ",").alias("c"))
    return rows.filter(F.size("c") == 3).select("name", F.col("c")[0].alias("left"), F.col("c")[1].alias("path"), F.col("c")[2].alias("right"))


def tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(tag, words) of lines whose first word is the tag of the document."""
    parts = F.split("value", " ", 2)
    return spark.read.text(path).filter("value <> ''").select(parts[0].alias("tag"), F.split(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), " ").alias("words"))


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A database table, read in parallel when bounds are among the options."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def embeddings(spark: SparkSession, vectors: str, labels: str) -> DataFrame:
    """(row, vec, label): vectors and labels of two line files of one order, joined by line number."""
    line = lambda p: numbered(spark.read.text(p).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("k")), ["f", "b", "k"], "row")
    v = line(vectors).select("row", F.transform(F.split("value", "\t"), lambda x: x.try_cast("double")).alias("vec"))
    return v.join(line(labels).select("row", F.split("value", "\t").alias("label")), "row")
