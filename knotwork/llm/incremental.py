"""New batches of papers checked against all that was accepted before (problem 4).

Rows are taken in the order of batch, then paper_id. A row leaves two kinds of hashes:

* **whole contents**: its normalised title and its directory name without the number of a copy, both run together, so
  that the slug of a title is the title. Rows that share one are full copies.
* **paragraphs** of the title, which is all the text there is: every three of its five stretches of words, with the
  first (or last) letters of the words of the other two; the title without its first word; its later parts; its first
  and second five words (met by a title that was cut off); the code link with the first and with the last three words.

Hashes live in tables of a :class:`HashStore`, bucketed by hash. A batch is looked up in the buckets of its own hashes
only (the history's side of these joins is not shuffled), its hashes are appended, and no text of the history is read
but that of rows which share a paragraph. Two rows that share a paragraph are one work if an exact comparison of the
titles finds nothing but slips of letters between them, a cut, or, under the same code link, lost words
(:func:`same_work`). Each row hangs on the earliest row that it matches, and with it on the accepted row of that work,
so the result does not depend on how rows are grouped into batches, and no later row joins two accepted works.

Hot hashes never pair: equal contents are reduced to their first row by aggregation, only rows of new content leave
paragraphs, and of each paragraph the first row is compared with all others (a star) before the rows that are still
open are compared with the rest.

Marks of an edition (``[v2]``, ``(with code)``) are not listed here but learned from the column: a bracketed or labelled
end of titles is a mark if the titles without it are known and mostly stand under the same directory name
(:func:`learned_marks`); a replication or sequel has a directory of its own.

Defined results: a null or empty title or directory name gives no hash, so such a row can only match by the other
fields; rows without either are accepted; repeated paper_ids keep their first row; null batches come first; a batch that
is checked again gets the verdicts it got before.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.session import shared_dir, stage_table

#: Stretches of a title and how many of them two titles must share.
STRETCHES, SHARED = 5, 3
#: Titles under one mark of an edition that must be known without it, share of them under the same directory name, most marks.
MARK_SUPPORT, MARK_SHARE, MOST_MARKS = 3, 0.5, 10_000
#: Letters of a title to one slip, beyond the two that any title may have.
LETTERS_PER_SLIP = 8
#: Hashes of one bucket of the store, about.
BUCKET_ROWS = 2_000_000

_WORD = re.compile(r"[^\W_]+")
_COUNTED = re.compile(r"\d+|[ivx]{1,4}")
_BEFORE = re.compile(r"^(?:[\[(]([^\[\]()]{1,40})[\])]\s*[:\-–]?|([^\s:\[(][^:\[(]{0,39}?):)\s+(?=\S)")
_AFTER = re.compile(r"\s*(?:[\[(]([^\[\]()]{1,40})[\])]|[,;:–]\s+([^,;:–\[(]{1,40}))$")


def plain(title: str | None) -> str:
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", title or "")).strip().lower().rstrip(".") if not (title or "").rstrip().endswith(("...", "…")) else re.sub(r"\s+", " ", unicodedata.normalize("NFKC", title)).strip().lower()


def ends_of(t: str) -> list[tuple[str, str]]:
    """(bracketed or labelled end, title without it) for the front and the back of a plain title."""
    out = []
    for m in (_BEFORE.match(t), _AFTER.search(t)):
        if m:
            out.append((" ".join(_WORD.findall(m[1] or m[2])), (t[m.end() :] if m.start() == 0 else t[: m.start()]).strip()))
    return out


def title_words(title: str | None, marks: frozenset[str] = frozenset()) -> tuple[list[str], bool, list[list[str]]]:
    """Words of a title without marks of an edition, whether it was cut off, and the words of its later parts.

    A bracketed end that is no mark of an edition becomes a word of its own, brackets and all.
    """
    t = plain(title)
    while True:
        t, before = next((rest for end, rest in ends_of(t) if end in marks and rest), t), t
        if t == before:
            break
    cut = t.endswith(("...", "…"))
    t = re.sub(r"^[\[(]([^\[\]()]{1,40})[\])]", lambda m: "\x00".join(["", *_WORD.findall(m[1]), ""]) + " ", t)
    parts = re.split(r":\s|\?\s|!\s|\s[-–—]\s|\.\s", t)
    words = lambda s: [w for w in re.findall(r"\x00[^ ]*|[^\W_]+", s) if w != "\x00"]
    tails = [words(" ".join(parts[k:])) for k in range(1, len(parts))]
    return words(t), cut, [x for x in tails if x]


def directory(name: str | None, words: list[str]) -> str:
    """Directory name without the number of a copy; a number that ends the title too is none of a copy."""
    d = "-".join(_WORD.findall(unicodedata.normalize("NFKC", name or "").lower().replace("_", "-")))
    m = re.search(r"-v?([1-9])$", d)
    return d[: m.start()] if m and words[-1:] != [m[0][1:]] else d


def code_link(link: str | None) -> str:
    """Host and path of a code link, without scheme, page, branch or suffix."""
    c = unicodedata.normalize("NFKC", link or "").strip().lower()
    c = re.sub(r"^git@([^:/]+):", r"\1/", c)
    c = re.sub(r"^(?:\w+:)?//", "", c)
    c = re.sub(r"^www\.", "", c)
    c = re.sub(r"[?#].*$", "", c).rstrip("/")
    c = re.sub(r"/(?:tree|blob|src|commits?)/.*$", "", c).rstrip("/")
    return c.removesuffix(".git")


# --- the exact check


def edits(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours, or more than ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def slips(a: list[str], b: list[str], more: int = 0) -> int:
    """Letters to change between titles of equally many words, ``more`` in a word than usual; 99 if a word or a count is another one."""
    if len(a) != len(b):
        return 99
    total = 0
    for x, y in zip(a, b, strict=True):
        if x == y:
            continue
        if x.isdigit() or y.isdigit() or (_COUNTED.fullmatch(x) and _COUNTED.fullmatch(y)):
            return 99
        most = more + (1 if max(len(x), len(y)) < 5 else 2 if max(len(x), len(y)) < 9 else 3)
        d = edits(x, y, most)
        if d > most:
            return 99
        total += d
    return total


def _few(a: list[str], b: list[str], more: int = 0) -> bool:
    return slips(a, b, more) <= max(2, sum(map(len, a)) // LETTERS_PER_SLIP)


def same_work(a: tuple, b: tuple, marks: frozenset[str] = frozenset()) -> bool:
    """Whether the later row b (title, directory name, code link) is the work of the earlier row a."""
    (wa, cut_a, _), (wb, cut_b, _) = title_words(a[0], marks), title_words(b[0], marks)
    da, db, la, lb = directory(a[1], wa), directory(b[1], wb), code_link(a[2]), code_link(b[2])
    if contents(a[0], a[1], marks) & contents(b[0], b[1], marks):
        return True
    if not wa or not wb:
        return False
    same_link = bool(la) and la == lb
    if _few(wa, wb, int(same_link)) and (slips(wa, wb) <= 2 or same_link or sum(map(len, wa)) > 40):
        return True
    if abs(len(wa) - len(wb)) == 1:
        # a blank came in or went, beside a slip or two
        short, long = (wa, wb) if len(wa) < len(wb) else (wb, wa)
        if edits("".join(wa), "".join(wb), 2) <= 2 and not any(long[:k] + long[k + 1 :] == short for k in range(len(long))):
            return True
        # a single letter of a name went
        if same_link and any(len(long[k]) == 1 and not long[k].isdigit() and 0 < k < len(long) - 1 and long[:k] + long[k + 1 :] == short for k in range(len(long))):
            return True
    for short, cut, long in ((wa, cut_a, wb), (wb, cut_b, wa)):
        if cut and 3 <= len(short) < len(long):
            near = bool(da and db) and (da.startswith(db) or db.startswith(da))
            # a later row that tells nothing else may be a cut of an accepted title, but not the other way round
            if (same_link or near or (cut_b and not ((la and lb) or (da and db)))) and (_few(short, long[: len(short)]) or short[:-1] == long[: len(short) - 1] and long[len(short) - 1].startswith(short[-1])):
                return True
    # under one link the later scrape may have lost the first word or the first part of the title, but a sequel adds words
    lost = [x for x in (wa[1:], *title_words(a[0], marks)[2]) if len(x) >= 3] if same_link and wa[0][0] != "\x00" else []
    return any(_few(x, wb) for x in lost)


# --- hashes


def _hash(kind: str, *parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join((kind, *parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def contents(title: str | None, dir_name: str | None, marks: frozenset[str] = frozenset()) -> set[int]:
    """Hashes of whole contents: the title and the directory name, run together."""
    words = title_words(title, marks)[0]
    return {_hash("whole", x) for x in ("".join(words), directory(dir_name, words).replace("-", "")) if x}


def paragraphs(title: str | None, link: str | None, marks: frozenset[str] = frozenset()) -> dict[int, bool]:
    """Hashes of parts of the title, and whether each may meet any other; where it is false only if the other may."""
    words, cut, tails = title_words(title, marks)
    c = code_link(link)
    if not words:
        return {}
    out = {_hash("part", *x): False for x in (words[1:], *tails) if len(x) >= 3}
    out |= {_hash(f"lead{k}", *words[k : k + 5]): cut for k in (0, 5) if len(words) >= k + 5}
    out[_hash("part", *words)] = True
    if c:
        out |= {_hash("first", c, *words[:3]): True, _hash("last", c, *words[-3:]): True}
    at = [round(k * len(words) / STRETCHES) for k in range(STRETCHES + 1)]
    parts = [words[at[k] : at[k + 1]] for k in range(STRETCHES)]
    for some in combinations(range(STRETCHES), SHARED):
        same = [" ".join(parts[k]) for k in some]
        rest = [w for k in range(STRETCHES) if k not in some for w in parts[k]]
        for kind, letter in (("a", 0), ("z", -1)):
            out[_hash(kind, str(some), str(len(words)), *same, "".join(w[letter] for w in rest))] = True
    return out


HASHED = "paper_id long, batch_no int, title string, stored_dir_name string, code string, wholes array<long>, parts array<struct<h:long,probe:boolean>>"
_FIELDS = ("paper_id", "batch_no", "title", "stored_dir_name", "code")


def _hash_task(marks: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("h", pa.int64()), ("probe", pa.bool_())]))
        for b in batches:
            columns = [b.column(c) for c in _FIELDS]
            rows = list(zip(*(x.to_pylist() for x in columns[2:]), strict=True))
            wholes = [sorted(contents(t, d, marks)) for t, d, _ in rows]
            parts = [[{"h": h, "probe": p} for h, p in sorted(paragraphs(t, c, marks).items())] for t, _, c in rows]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(wholes, pa.list_(pa.int64())), pa.array(parts, kind)], [*_FIELDS, "wholes", "parts"])

    return run


def hashed(paper: DataFrame, marks: frozenset[str] = frozenset()) -> DataFrame:
    """One row per paper_id with its hashes."""
    rows = paper.filter(F.col("paper_id").isNotNull()).select("paper_id", F.coalesce("batch_no", F.lit(-1)).cast("int").alias("batch_no"), "title", "stored_dir_name", "code")
    first = rows.groupBy("paper_id").agg(F.min_by(F.struct("batch_no", "title", "stored_dir_name", "code"), "batch_no").alias("r"))
    return first.select("paper_id", "r.*").mapInArrow(_hash_task(marks), HASHED)


def _ends_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for title, name in zip(b.column("title").to_pylist(), b.column("stored_dir_name").to_pylist(), strict=True):
            words = title_words(title)[0]
            slug = directory(name, words)
            if words and slug:
                out.append(("", _hash("whole", "".join(words)), _hash("whole", slug)))
                ends = ends_of(plain(title))
                # a title with marks at both ends may only be known without both
                ends += [(end, bare) for end, rest in ends for other, bare in ends_of(rest) if other in {e for e, _ in ends}]
                out += [(end, _hash("whole", "".join(_WORD.findall(rest))), _hash("whole", slug)) for end, rest in ends if end and _WORD.search(rest)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["mark", "rest", "slug"])


def learned_marks(paper: DataFrame) -> frozenset[str]:
    """Bracketed or labelled ends of titles that leave the work the same.

    A mark has at least ``MARK_SUPPORT`` titles which are known without it, and ``MARK_SHARE`` of those stand under
    the directory name of the title without it. Only these few ends come to the driver, and their number is checked.
    """
    seen = paper.select("title", "stored_dir_name").mapInArrow(_ends_task, "mark string, rest long, slug long").distinct()
    bare = seen.filter("mark = ''").select("rest", F.col("slug").alias("bare_slug"), F.lit(1).alias("known"))
    known = bare.select("rest", "known").distinct()
    ends = seen.filter("mark <> ''").join(known, "rest", "left_semi").join(bare.withColumnRenamed("bare_slug", "slug").distinct(), ["rest", "slug"], "left")
    each = ends.groupBy("mark").agg(F.count_distinct("rest").alias("titles"), F.avg(F.coalesce("known", F.lit(0))).alias("share"))
    marks = [r[0] for r in each.filter((F.col("titles") >= MARK_SUPPORT) & (F.col("share") >= MARK_SHARE)).select("mark").limit(MOST_MARKS + 1).collect()]
    if len(marks) > MOST_MARKS:
        raise ValueError(f"more than {MOST_MARKS} marks of editions")
    return frozenset(marks)


def _same_task(marks: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("title_a", "stored_dir_name_a", "code_a", "title_b", "stored_dir_name_b", "code_b")
        ids = ("paper_id_a", "batch_no_a", "paper_id_b")
        for b in batches:
            mask = pa.array([same_work(r[:3], r[3:], marks) for r in zip(*(b.column(c).to_pylist() for c in names), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(mask) for c in ids], list(ids))

    return run


class HashStore:
    """The hashes and verdicts of all rows seen so far, in tables bucketed by hash or paper_id under one folder.

    ``wholes`` maps a content to its first row; ``parts`` holds the paragraphs of rows of new content, ``texts`` the
    fields of those rows, ``works`` the accepted row of every row. Rows are appended under the number of an attempt,
    which counts once its marker file stands in ``_done``: a batch that failed half way leaves nothing behind.
    """

    TABLES = {
        "wholes": ("h long, batch_no int, paper_id long, attempt int", "h"), "parts": ("h long, probe boolean, batch_no int, paper_id long, attempt int", "h"),
        "texts": ("paper_id long, title string, stored_dir_name string, code string, attempt int", "paper_id"), "works": ("paper_id long, batch_no int, root long, attempt int", "paper_id"),
    }

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 32, marks: frozenset[str] = frozenset()) -> None:
        self.spark, self.folder, self.buckets, self.marks = spark, folder, buckets, marks
        self.name = f"knotwork_{uuid.uuid4().hex}"
        for t, (columns, key) in self.TABLES.items():
            spark.sql(f"CREATE TABLE {self.name}_{t} ({columns}) USING parquet CLUSTERED BY ({key}) INTO {buckets} BUCKETS LOCATION '{folder}/{t}'")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_done")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.done = sorted(int(f.getPath().getName()) for f in fs.listStatus(path)) if fs.exists(path) else []
        self.attempt = max(self.done, default=-1)

    def _read(self, t: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{t}").filter(F.col("attempt").isin(self.done)).drop("attempt")

    def _append(self, t: str, rows: DataFrame) -> None:
        columns, key = self.TABLES[t]
        names = [c.split()[0] for c in columns.split(", ")]
        # one file per bucket and batch
        rows.withColumn("attempt", F.lit(self.attempt)).select(*names).repartition(self.buckets, key).write.insertInto(f"{self.name}_{t}")

    def _commit(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/_done/{self.attempt}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True).close()
        self.done.append(self.attempt)

    def _matches(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """(paper_id, batch_no_a, paper_id_a): the earliest row of those met that the exact check finds to be the work."""
        side = lambda end: texts.select(*(F.col(c).alias(f"{c}_{end}") for c in ("paper_id", "title", "stored_dir_name", "code")))
        told = pairs.distinct().join(side("a"), "paper_id_a").join(side("b"), "paper_id_b")
        told = told.select("paper_id_a", "batch_no_a", "paper_id_b", *(f"{c}_{e}" for e in "ab" for c in ("title", "stored_dir_name", "code")))
        same = told.mapInArrow(_same_task(self.marks), "paper_id_a long, batch_no_a int, paper_id_b long")
        return same.groupBy(F.col("paper_id_b").alias("paper_id")).agg(F.min(F.struct("batch_no_a", "paper_id_a")).alias("up")).select("paper_id", "up.*")

    def check_batch(self, batch: DataFrame) -> DataFrame:
        """(paper_id_a, paper_id_b) of a batch's rows of known works; then the batch is part of the history."""
        self.attempt += 1
        new = stage_table(hashed(batch, self.marks), "batch")
        ids = new.select("paper_id")
        if self.done:
            new = new.join(self._read("works").select("paper_id"), "paper_id", "left_anti")
        place = lambda end="": F.struct(F.col(f"batch_no{end}"), F.col(f"paper_id{end}"))

        # full copies: every content of the batch with its first row in the history or, failing that, in the batch
        wholes = new.select("paper_id", "batch_no", F.explode("wholes").alias("h"))
        firsts = wholes.groupBy("h").agg(F.min(place()).alias("own"))
        if self.done:
            firsts = firsts.join(self._read("wholes").select("h", place().alias("old")), "h", "left")
        else:
            firsts = firsts.withColumn("old", F.lit(None).cast("struct<batch_no:int,paper_id:long>"))
        up = wholes.join(firsts.select("h", F.least("own", "old").alias("first")), "h").groupBy("paper_id").agg(F.min("first").alias("first"))
        rows = new.join(up, "paper_id", "left").withColumn("is_copy", F.coalesce(F.col("first.paper_id") != F.col("paper_id"), F.lit(False)))
        rows = stage_table(rows.select("paper_id", "batch_no", "title", "stored_dir_name", "code", "parts", "first", "is_copy"), "rows")
        self._append("wholes", firsts.filter("old is null").select("h", "own.*"))
        copies = rows.filter("is_copy").select("paper_id", F.col("first.batch_no").alias("batch_no_a"), F.col("first.paper_id").alias("paper_id_a"))

        # paragraphs of what is new
        fresh = rows.filter("not is_copy")
        self._append("texts", fresh)
        self._append("parts", fresh.select("paper_id", "batch_no", F.explode("parts").alias("p")).select("p.*", "batch_no", "paper_id"))
        both = [*self.done, self.attempt]
        parts = self.spark.table(f"{self.name}_parts").filter(F.col("attempt").isin(both))
        texts = self.spark.table(f"{self.name}_texts").filter(F.col("attempt").isin(both))
        mine = parts.filter(F.col("attempt") == self.attempt).select("h", F.col("probe").alias("probe_b"), F.col("batch_no").alias("batch_no_b"), F.col("paper_id").alias("paper_id_b"))
        near = parts.join(mine.select("h").distinct(), "h", "left_semi") if self.done else parts
        old = near.select("h", F.col("probe").alias("probe_a"), F.col("batch_no").alias("batch_no_a"), F.col("paper_id").alias("paper_id_a"))
        heads = old.groupBy("h").agg(F.min(F.struct("batch_no_a", "paper_id_a", "probe_a")).alias("a")).select("h", "a.*")
        may = (place("_a") < place("_b")) & (F.col("probe_a") | F.col("probe_b"))
        pair = lambda a, b: a.join(b, "h").filter(may).select("paper_id_a", "batch_no_a", "paper_id_b")
        star = stage_table(self._matches(pair(heads, mine), texts), "star")
        open_rows = mine.join(star.select(F.col("paper_id").alias("paper_id_b")), "paper_id_b", "left_anti")
        rest = self._matches(pair(old, open_rows), texts)
        found = copies.unionByName(star).unionByName(rest)

        # the accepted row of the row that each hangs on
        if self.done:
            known = self._read("works").select(F.col("paper_id").alias("paper_id_a"), F.col("root"))
            found = found.join(known, "paper_id_a", "left").select("paper_id", F.coalesce("root", "paper_id_a").alias("root"))
        else:
            found = found.select("paper_id", F.col("paper_id_a").alias("root"))
        found = stage_table(found, "found")
        while True:
            above = found.select(F.col("paper_id").alias("root"), F.col("root").alias("above"))
            step = found.join(above, "root")
            if step.isEmpty():
                break
            found = stage_table(found.join(above, "root", "left").select("paper_id", F.coalesce("above", "root").alias("root")), "found")
        self._append("works", rows.select("paper_id", "batch_no").join(found, "paper_id", "left").withColumn("root", F.coalesce("root", "paper_id")))
        self._commit()
        return self.verdicts().join(ids.withColumnRenamed("paper_id", "paper_id_b"), "paper_id_b", "left_semi").select("paper_id_a", "paper_id_b")

    def close(self, remove: bool = False) -> None:
        """Take the tables out of the catalog; their files stay for the next session unless they are to be removed."""
        for t in self.TABLES:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{t}")
        if remove:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def verdicts(self) -> DataFrame:
        """(paper_id_a, paper_id_b): every row of a known work so far with the accepted row of that work."""
        return self._read("works").filter("root <> paper_id").select(F.col("root").alias("paper_id_a"), F.col("paper_id").alias("paper_id_b"))


def found(paper: DataFrame) -> DataFrame:
    """(paper_id_a, paper_id_b): the batches one after another, each checked against all before it and itself."""
    spark = paper.sparkSession
    batches = paper.filter("paper_id is not null").groupBy("batch_no").count().orderBy(F.col("batch_no").asc_nulls_first()).collect()
    hashes = sum(r["count"] for r in batches) * 2 * (STRETCHES * (STRETCHES - 1) // 2)
    store = HashStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", max(6, -(-hashes // BUCKET_ROWS)), learned_marks(paper))
    for r in batches:
        store.check_batch(paper.filter(F.col("batch_no").eqNullSafe(F.lit(r["batch_no"]))))
    out = stage_table(store.verdicts(), "works")
    store.close(remove=True)
    return out
