"""Generated, minified, packed and vendored source files, and files that only hold data (problem 5).

1. **Declared files.** Rows of the table that are repository attribute files (``.gitattributes`` in any directory) are
   parsed; globs are resolved per directory, deeper directories and later lines taking precedence, ``-attr`` and
   ``attr=false`` take a mark away, ``!attr`` leaves it unsaid. What a repository says overrides everything else. Where
   it says nothing, the bundled attribute file ``attributes.txt`` (paths that tools are documented to use) speaks, and
   the few markers that generators are documented to write (``MARKERS``).
2. **Mined equivalents.** What declared files look like is learned from the whole table and applied to all others:
   * *notes*: pairs of neighbouring words in the leading comments. Each file counts for its most telling pair only (by
     the information gain about being declared), so that words which merely stand beside a notice are explained away; a
     pair is adopted if at least ``LEAST_SHARE`` of its files are declared.
   * *shapes*: packed lines, literal data, counted names, module tables, pinned versions, each a share of the file in
     steps of ``STEP``; the threshold of each is the step from which on at least ``LEAST_SHARE`` of the files are declared.
   Only a part of all generated files stands under a telling path, and hardly any hand-written one does, so a small share
   of declared files tells a pattern of tools: ``LEAST_SHARE`` is far above the share that hand-written looks reach.
3. **Copies.** Paragraph fingerprints of all vendored files form a table; a file elsewhere at least half of whose text (by
   length) lies in such paragraphs is a copy too. A directory name whose files are found in at least ``PATH_SHARE`` of at
   least ``PATH_SUPPORT`` files marks the rest of its files.

Everything of a file is computed in one pass of Arrow batches; what is kept (hashes of pairs, shapes, fingerprints of 8
bytes per paragraph) is written once to the shared folder, so texts are read once. Statistics are pre-aggregated; rules
of a repository meet its files as one row, so a repository that holds a third of all files makes no pairs.

Defined results: null or empty ``code`` is no case; notebooks and XML have no shapes, JSON only that of pinned versions;
whole texts are read; line ends do not matter; repeated rows give one row of ``found``, and of
different rows with one file_id the one with the least hash counts; attribute files are no cases.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.tabular import first_seen
from knotwork.session import stage_table

#: Share and number of declared files from which on a pattern is adopted, and the step of shapes.
LEAST_SHARE, LEAST_FILES, STEP = 0.08, 2, 0.05
#: A directory name is mined as a pattern from so many files on, if this share of them is found.
PATH_SUPPORT, PATH_SHARE = 20, 0.9
#: Share of a file's text that lies in paragraphs of third-party files, and least characters of a paragraph.
COPY_SHARE, PARAGRAPH = 0.5, 60
#: Pairs of words that generators are documented to write.
MARKERS = ("^ @generated", "not edit", "^ autogenerated", "automatically generated")

EVIDENCE = (
    "file_id long, stored_dir_name string, code_path string, row long, bundled string, notes array<long>, shapes array<struct<shape:string,step:int>>, "
    "prints array<struct<h:long,n:int>>, attributes string"
)

_COMMENT = re.compile(r"\s*(?:#(?!!)|//+|/\*+!?|\*+/?|<!--+|--+|;+)\s?(.*)")
_TABLE = re.compile(r"/\*{3}/|\b__webpack_require__\b|^\s*\d+:\s*\[?\s*function\s*\(\s*\w+,\s*\w+,\s*\w+\s*\)", re.M)
_PINNED = re.compile(r'"[\^~]?\d+\.\d+\.\d+[^"]*"|https?://|"sha\d+-|"[\da-f]{32,}"')
_NUMBERED = re.compile(r"([A-Za-z_][A-Za-z_]*?)(\d+)_?\b")
_LITERAL = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|(?<![\w.])[-+]?(?:0[xX][\da-fA-F]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|[\s\[\](){},:;=]+""")
_ASSIGNS = re.compile(r"\s*(?:(?:var|let|const)\s+)?[\w.]+\s*=")
_ENDS_IN_DIGIT = re.compile(r"[A-Za-z_]\d")
_STATEMENTS = ("return", "def ", "function", "import ", "class ", "for (", "for ", "if ", "print")
_PARA = re.compile(r"\n[ \t]*\n")
_PAIR_WORD = re.compile(r"@?[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


def _numbered_share(lines: list[str]) -> float:
    """Share of lines that continue a count: a name whose number is equal to the last one of that name or up to two more."""
    last: dict[str, int] = {}
    hits = runs = 0
    for line in lines:
        good = False
        for stem, number in _NUMBERED.findall(line):
            n, before = int(number[:9]), last.get(stem)
            if before is not None and n - before in (0, 1, 2):
                good = True
                runs += n - before
            last[stem] = n
        hits += good
    return hits / max(1, len(lines)) if runs >= 6 else 0.0


def leading_comments(path: str, code: str) -> Iterator[str]:
    """Lines of all comments before the first line of code; imports, package lines and text literals may stand between."""
    if path.lower().endswith((".json", ".ipynb")):
        return
    closes = ""  # end mark of an open block comment
    for line in code.split("\n"):
        if not line.strip():
            continue
        m = re.match(r"(.*)", line) if closes else _COMMENT.match(line)
        if closes:
            closes = "" if closes in line else closes
        elif m and (block := re.match(r"\s*(/\*|<!--)", line)):
            end = "*/" if block[1] == "/*" else "-->"
            closes = "" if end in line[block.end() :] else end
        if m:
            yield m[1].strip().lstrip("*").rstrip("*/->").strip()
        elif not line.strip().startswith(("import ", "from ", "package ", '"""', "'use strict'", "#!", "<?xml")):
            return


def notes(path: str, code: str) -> set[str]:
    """Pairs of neighbouring words of the leading comments, with ``^`` for the begin of a line and 0 for any number."""
    out = set()
    for line in leading_comments(path, code):
        words = ["^", *("0" if w.isdigit() else w for w in _PAIR_WORD.findall(line.lower()))]
        out.update(map(" ".join, zip(words, words[1:])))  # noqa: B905
    return out


def shapes(path: str, code: str) -> dict[str, float]:
    """Shares from 0 to 1 of what tools rather than people write; none for languages without shapes."""
    ext = path.rsplit(".", 1)[-1].lower()
    lines = [x for x in code.split("\n") if x.strip()]
    if not lines:
        return {}
    if ext == "json":
        return {"pinned versions": sum(1 for x in lines if _PINNED.search(x)) / len(lines)}
    if ext not in ("py", "js", "java"):
        return {}
    out = {"module table": min(1.0, len(_TABLE.findall(code)) / len(lines))}
    # few statements and nearly nothing besides literals and punctuation
    few = max(3, len(lines) // 10)
    if sum(map(code.count, _STATEMENTS)) <= 2 * few and lines[0].lstrip()[:1] not in "<#-|" and sum(1 for x in lines if _ASSIGNS.match(x)) <= few:
        out["only data"] = 1 - len(_LITERAL.sub("", code)) / len(code)
    out["packed code"] = sum(len(x) for x in lines if len(x) > 80 and x.count(" ") < 0.08 * len(x) and sum(map(x.count, ";{}")) > len(x) / 60) / len(code)
    if len(lines) >= 8 and len(_ENDS_IN_DIGIT.findall(code)) >= 0.4 * len(lines):
        out["counted names"] = _numbered_share(lines)
    return out


@lru_cache(1 << 16)
def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def fingerprints(code: str) -> list[dict[str, int]]:
    """One print per paragraph of ``PARAGRAPH`` characters or more, blind to line ends, indents and comments."""
    out = []
    for p in _PARA.split(code.replace("\r\n", "\n")):
        flat = " ".join(x for x in (y.strip() for y in p.split("\n")) if not x.startswith(("#", "//")))
        if len(flat) >= PARAGRAPH:
            out.append({"h": _hash(flat), "n": len(flat)})
    return out


def glob_regex(pattern: str) -> str:
    """Regular expression of one attribute glob, for paths relative to the directory of its file.

    A glob with a slash before its last character is bound to that directory, any other meets the name at any depth.
    """
    anchored = "/" in pattern[:-1]
    pattern = pattern.removeprefix("/")
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out += "(?:.*/)?"
            k += 3
        elif pattern.startswith("**", k):
            out += ".*"
            k += 2
        elif pattern[k] == "*":
            out += "[^/]*"
            k += 1
        elif pattern[k] == "?":
            out += "[^/]"
            k += 1
        elif pattern[k] == "\\" and k + 1 < len(pattern):
            out += re.escape(pattern[k + 1])
            k += 2
        elif pattern[k] == "[" and "]" in pattern[k:]:
            e = pattern.index("]", k)
            out += "[" + pattern[k + 1 : e].replace("!", "^", 1) + "]"
            k = e + 1
        else:
            out += re.escape(pattern[k])
            k += 1
    return ("" if anchored else "(?:.*/)?") + out + r"\Z"


def parse_attributes(text: str) -> list[tuple[str, str, bool | None]]:
    """(regular expression, generated or vendored, set, unset or None for unsaid) of each line, in order.

    A pattern in double quotes may hold blanks and escapes.
    """
    rules = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        m = re.match(r'\s*(?:"((?:[^"\\]|\\.)*)"|([^\s#"]\S*))\s+(\S.*)', line)
        if not m:
            continue
        pattern = re.sub(r"\\(.)", r"\1", m[1]) if m[1] is not None else m[2]
        for attr in m[3].split():
            a = re.fullmatch(r"([-!]?)(?:linguist-)?(generated|vendored)(?:=(\w+))?", attr)
            if a:
                rules.append((glob_regex(pattern), a[2], None if a[1] == "!" else not a[1] and (a[3] or "true").lower() != "false"))
    return rules


@cache
def _bundled() -> list[tuple[re.Pattern, str]]:
    return [(re.compile(r), kind) for r, kind, _ in parse_attributes((Path(__file__).parent / "attributes.txt").read_text())]


def bundled_kind(path: str) -> str | None:
    """generated or vendored, as the bundled attribute file says of a path."""
    return next((kind for rule, kind in _bundled() if rule.match(path)), None)


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prints_type, shapes_type = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])), pa.list_(pa.struct([("shape", pa.string()), ("step", pa.int32())]))
    keep = ["file_id", "stored_dir_name", "code_path", "row"]
    for b in batches:
        kinds, pairs, steps, prints, attributes = [], [], [], [], []
        for path, code in zip(b.column("code_path").to_pylist(), b.column("code").to_pylist(), strict=True):
            path = path or ""
            if path.rsplit("/", 1)[-1] == ".gitattributes":
                kind, pair, step, print_, rules = None, [], [], [], code
            else:
                words = notes(path, code)
                kind = bundled_kind(path) or ("generated" if words.intersection(MARKERS) else None)
                pair = sorted(map(_hash, words))
                step = [{"shape": k, "step": int(v / STEP + 1e-9)} for k, v in shapes(path, code).items() if v >= STEP]
                print_ = fingerprints(code) if path.lower().endswith((".py", ".js", ".java")) else []
                rules = None
            for column, value in zip((kinds, pairs, steps, prints, attributes), (kind, pair, step, print_, rules), strict=True):
                column.append(value)
        arrays = [pa.array(kinds, pa.string()), pa.array(pairs, pa.list_(pa.int64())), pa.array(steps, shapes_type), pa.array(prints, prints_type), pa.array(attributes, pa.string())]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *arrays], [*keep, "bundled", "notes", "shapes", "prints", "attributes"])


@lru_cache(1 << 10)
def _rules(files: tuple[tuple[str, str], ...]) -> list[tuple[str, re.Pattern, str, bool | None]]:
    """(directory, expression, attribute, value) of the attribute files of a repository, the strongest last."""
    return [(base, re.compile(rule), kind, value) for base, text in sorted(files, key=lambda f: (f[0].count("/"), f[0])) for rule, kind, value in parse_attributes(text)]


def declared_kind(path: str, files: tuple[tuple[str, str], ...]) -> str | None:
    """generated, vendored or by hand, as attribute files ((directory, text) pairs) say of a path; None if unsaid."""
    said: dict[str, bool | None] = {}
    for base, rule, kind, value in _rules(files):
        if path.startswith(base) and rule.match(path[len(base) :]):
            said[kind] = value
    set_to = [k for k in ("vendored", "generated") if said.get(k)]
    return set_to[0] if set_to else "by hand" if False in said.values() else None


def _declared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(b.column("code_path").to_pylist(), b.column("files").to_pylist(), strict=True)
        kinds = [declared_kind(path or "", tuple((f["base"], f["attributes"]) for f in files)) for path, files in rows]
        yield pa.RecordBatch.from_arrays([b.column("file_id"), pa.array(kinds, pa.string())], ["file_id", "declared"])


def declared(seen: DataFrame) -> DataFrame:
    """(file_id, declared) for files that an attribute file of their repository speaks of.

    The attribute files of a repository become one row, which its files meet where they lie; no pairs of files and
    rules are made.
    """
    base = F.regexp_extract("code_path", r"^(.*/)?[^/]*$", 1).alias("base")
    rules = seen.filter("attributes is not null").groupBy("stored_dir_name").agg(F.sort_array(F.collect_set(F.struct(base, "attributes"))).alias("files"))
    files = seen.filter("attributes is null").select("file_id", "stored_dir_name", "code_path").join(rules, "stored_dir_name")
    said = files.select("file_id", "code_path", "files").mapInArrow(_declared, "file_id long, declared string")
    return said.groupBy("file_id").agg(F.max("declared").alias("declared"))


def mined_notes(seen: DataFrame) -> DataFrame:
    """(file_id, note, kind) of files whose most telling pair of words is one of tools, with the attribute it goes with.

    ``seen`` has kind, the declared attribute or null.
    """
    told = F.count("kind")
    all_files, all_told = seen.agg(F.count(F.lit(1)), told).first()
    base = all_told / all_files if all_told else 1.0
    words = seen.select("file_id", "kind", F.explode("notes").alias("h"))
    share = F.col("told") / F.col("files")
    each = words.groupBy("h").agg(F.count(F.lit(1)).alias("files"), told.alias("told")).filter((F.col("told") >= LEAST_FILES) & (share >= LEAST_SHARE))
    each = each.filter(share > base).select("h", (F.col("told") * F.log2(share / base)).alias("gain"))
    best = words.join(each, "h").groupBy("file_id").agg(F.max(F.struct("gain", "h")).alias("b"), F.max("kind").alias("kind")).select("file_id", "kind", F.col("b.h").alias("h"))
    kept = best.groupBy("h").agg(F.count(F.lit(1)).alias("files"), told.alias("told"), F.count(F.when(F.col("kind") == "vendored", 1)).alias("vendored"))
    kept = kept.filter((F.col("told") >= LEAST_FILES) & (share >= LEAST_SHARE))
    return best.select("file_id", "h").join(kept.select("h", F.when(F.col("vendored") * 2 > F.col("told"), "vendored").otherwise("generated").alias("note_kind")), "h")


def mined_shapes(seen: DataFrame) -> dict[str, int]:
    """The step from which on a shape is one of tools, by isotonic regression of the share of declared files.

    Neighbouring steps are pooled until the share does not fall from one pool to the next; the first pool with a share
    of ``LEAST_SHARE`` begins at the threshold. At most five shapes of twenty steps come to the driver.
    """
    steps = seen.select("kind", F.explode("shapes").alias("s")).groupBy("s.shape", "s.step").agg(F.count(F.lit(1)).alias("files"), F.count("kind").alias("told"))
    pools: dict[str, list[list[int]]] = {}
    for shape, step, files, told in sorted(map(tuple, steps.collect())):
        own = pools.setdefault(shape, [])
        own.append([step, files, told])
        while len(own) > 1 and own[-1][2] * own[-2][1] <= own[-2][2] * own[-1][1]:
            _, files, told = own.pop()
            own[-1][1] += files
            own[-1][2] += told
    out = {}
    for shape, own in pools.items():
        kept = [step for step, files, told in own if told >= LEAST_FILES and told >= LEAST_SHARE * files]
        if kept:
            out[shape] = kept[0]
    return out


def reasons(repo: DataFrame) -> DataFrame:
    """(file_id, stored_dir_name, code_path, reason) for every file that is not hand-written."""
    files = repo.filter(F.col("code").isNotNull() & (F.length(F.trim("code")) > 0) & F.col("file_id").isNotNull()).select("file_id", "stored_dir_name", "code_path", "code", F.xxhash64("code_path", "code").alias("row"))
    seen = first_seen(files.mapInArrow(_evidence, EVIDENCE), ["file_id"], ["row"])
    seen = stage_table(seen, "evidence")
    if seen.filter("attributes is not null").isEmpty():
        seen = seen.withColumn("declared", F.lit(None).cast("string"))
    else:
        seen = stage_table(seen.filter("attributes is null").join(declared(seen), "file_id", "left"), "declared")
    kind = F.when(F.col("declared").isNull(), F.col("bundled")).when(F.col("declared") != "by hand", F.col("declared"))
    seen = seen.withColumn("kind", kind)
    seen = seen.join(mined_notes(seen).select("file_id", "note_kind"), "file_id", "left")
    from_step = mined_shapes(seen.select("kind", "shapes"))
    steps = F.create_map(*(F.lit(x) for kv in sorted(from_step.items()) for x in kv)).cast("map<string,int>")
    shape = F.get(F.filter("shapes", lambda x: F.coalesce(x["step"] >= F.try_element_at(steps, x["shape"]), F.lit(False))), F.lit(0))["shape"]
    reason = F.when(F.col("declared").isNotNull(), F.concat(F.lit("declared "), "declared")).otherwise(
        F.coalesce(F.concat(F.lit("mined shape: "), shape), F.concat(F.lit("mined note: "), "note_kind"), F.concat("bundled", F.lit(" path")))
    )
    seen = stage_table(seen.select("file_id", "stored_dir_name", "code_path", "prints", "declared", reason.alias("reason"), F.coalesce("kind", "note_kind").alias("kind")), "reasons")
    # copies of third-party files
    known = seen.filter("kind = 'vendored'").select(F.explode("prints.h").alias("h")).distinct()
    rest = seen.filter(F.col("reason").isNull() & (F.size("prints") > 0))
    shared = rest.select("file_id", F.explode("prints").alias("p")).select("file_id", F.col("p.h").alias("h"), F.col("p.n").alias("n")).join(known, "h", "left_semi").groupBy("file_id").agg(F.sum("n").alias("shared"))
    copies = rest.select("file_id", F.aggregate("prints", F.lit(0), lambda a, x: a + x["n"]).alias("size")).join(shared, "file_id").filter(F.col("shared") >= COPY_SHARE * F.col("size"))
    copies = copies.select("file_id", F.lit("copy of a third-party file").alias("copy"))
    # directory names of which nearly all files are found
    folders = F.slice(F.split("code_path", "/"), 2, F.greatest(F.size(F.split("code_path", "/")) - 2, F.lit(0)))
    names = seen.select("file_id", F.coalesce(F.startswith("reason", F.lit("mined")), F.lit(False)).cast("int").alias("own"), F.explode(F.array_distinct(folders)).alias("name"))
    mined = names.groupBy("name").agg(F.count(F.lit(1)).alias("files"), F.avg("own").alias("share")).filter((F.col("files") >= PATH_SUPPORT) & (F.col("share") >= PATH_SHARE)).select("name")
    in_mined = names.filter("own = 0").join(mined, "name", "left_semi").select("file_id").distinct().withColumn("mined", F.lit("mined path"))
    out = seen.drop("prints").join(copies, "file_id", "left").join(in_mined, "file_id", "left")
    reason = F.when(F.coalesce("declared", F.lit("")) != "by hand", F.coalesce("reason", "copy", "mined"))
    return out.select("file_id", "stored_dir_name", "code_path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def found(repo: DataFrame) -> DataFrame:
    """file_id of every file that its authors did not write by hand."""
    return reasons(repo).select("file_id").distinct()


def summary(repo: DataFrame) -> DataFrame:
    """Files not written by hand per repository and reason."""
    return reasons(repo).groupBy("stored_dir_name", "reason").agg(F.count_distinct("file_id").alias("files"))
