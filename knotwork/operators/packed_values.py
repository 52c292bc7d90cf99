"""Several values packed in one field, one per row with its position (problem 2).

Every field becomes a lattice: nodes are places where a value may begin, edges are readings of what stands there (a
quoted span up to any quote that can close it, a plain run up to the next separator, the whole of a bracket or its
parts). Quoted spans are atomic and a backslash protects what follows. Most fields have one path. For the others value
frequencies are learned from the whole column by expectation maximisation: fields with one path give counts, fields
with more give expected counts by forward and backward sums over their lattices, and after ``ROUNDS`` rounds a Viterbi
pass takes the likeliest path. Frequencies are a table that is joined to the readings by value; nothing that grows
with the data is sent to every task, and counts are aggregated before they are shuffled.

Defined results: null and blank fields, ``None``, ``N/A``, ``null`` and empty lists give no row; empty values are
dropped and do not count as positions; repeated values are kept; repeated rows of one key give the same rows once;
fields of any length are read whole; ties go to the reading with the nearest closing quote.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import stage_table

#: Rounds of expectation maximisation.
ROUNDS = 3
#: Taken off every count, so that a reading can't vouch for itself by its own small share.
DISCOUNT = 0.5
#: Characters that part values.
SEPARATORS = ",;|/、\t\n\r"
_CLOSES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "„": "“"}
_NOTHING = re.compile(r"(?:none|n/a|null|nan|\[\s*\]|\{\s*\}|\(\s*\))?", re.I)
_ROW_OF_BRACKETS = re.compile(r"\[[^\[\]]*\](?:\s*[,;|/、]?\s*\[[^\[\]]*\])*")
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)
#: Log weights of readings that keep a quote as a letter, or ignore quotes within a value.
_KEPT_QUOTE, _BROKEN_QUOTE = -9.0, -6.0

Edge = tuple[int, int, str, float]


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else {"n": "\n", "t": "\t"}.get(m[1], m[1]), s)


def _unquote(s: str, quote: str) -> str:
    return _unescape(s.replace(quote * 2, quote) if quote in "\"'" else s).strip()


def _skip(text: str, k: int) -> int:
    while k < len(text) and text[k].isspace() and text[k] not in SEPARATORS:
        k += 1
    return k


def _plain_end(text: str, k: int, shield: bool) -> int:
    """Where a plain value that begins at k ends; with ``shield``, quoted spans within it hide separators."""
    while k < len(text):
        c = text[k]
        if c == "\\":
            k += 2
            continue
        if c in SEPARATORS:
            return k
        if shield and c in "\"“«" and (k == 0 or not text[k - 1].isalnum()):
            e = text.find(_CLOSES[c], k + 1)
            if e > 0:
                k = e
        k += 1
    return min(k, len(text))


def _readings(text: str, base: int = 0) -> list[Edge]:
    """Edges (from, to, value, log weight) of a field without outer brackets; empty values have no text."""
    out: list[Edge] = []
    todo, done = [0], set()
    n = len(text)
    while todo:
        p = todo.pop()
        if p in done or p > n:
            continue
        done.add(p)
        k = _skip(text, p)
        if k >= n:
            if p < n + 1:
                out.append((base + p, base + n + 1, "", 0.0))
            continue
        c = text[k]
        ends: list[tuple[int, str, float]] = []
        if c in SEPARATORS:
            ends.append((k + 1, "", 0.0))
        else:
            quoted = False
            if c in _CLOSES:
                close = _CLOSES[c]
                e = k + 1
                while e < n:
                    if text[e] == "\\":
                        e += 2
                        continue
                    if text[e] == close:
                        run = e
                        if c in "\"'":
                            while run + 1 < n and text[run + 1] == close:
                                run += 1
                        after = _skip(text, run + 1)
                        # of a run of doubled quotes the last one closes if the run is odd
                        if ((run - e) % 2 == 0 or run == e) and (after >= n or text[after] in SEPARATORS):
                            ends.append((after + 1 if after < n else n + 1, _unquote(text[k + 1 : run], c), -0.01 * len(ends)))
                            quoted = True
                        e = run
                    e += 1
            for shield in (True, False):
                e = _plain_end(text, k, shield)
                value = _unescape(text[k:e]).strip()
                weight = (_KEPT_QUOTE if quoted else 0.0) + (0.0 if shield else _BROKEN_QUOTE)
                to = e + 1 if e < n else n + 1
                if not any(t == to and v == value for t, v, _ in ends):
                    ends.append((to, value, weight))
        for to, value, weight in ends:
            out.append((base + p, base + to, value, weight))
            todo.append(to)
    return out


def lattice(field: str | None) -> list[Edge]:
    """All readings of a field as edges of a lattice from 0 to its last node; no edge if it holds nothing."""
    if field is None:
        return []
    t = field.strip()
    if _NOTHING.fullmatch(t):
        return []
    if t[0] == "[" and t[-1] == "]" and _ROW_OF_BRACKETS.fullmatch(t):
        out: list[Edge] = []
        base = 0
        for m in re.finditer(r"\[([^\[\]]*)\]", t):
            inner = m[1].strip()
            size = len(inner) + 1
            if not inner or inner.lower() in ("none", "null"):
                out.append((base, base + size, "", 0.0))
            else:
                parts = _readings(inner, base)
                out += parts
                if inner[0] not in _CLOSES and any(c in SEPARATORS for c in inner):
                    # a plain bracket may also hold one value that has a separator in it
                    out.append((base, base + size, _unescape(inner), -0.5))
            base += size
        return out
    if (t[0], t[-1]) in (("[", "]"), ("{", "}"), ("(", ")")):
        inner = t[1:-1]
        if t[0] != "(" or inner.strip()[:1] in _CLOSES:
            return _readings(inner)
    return _readings(t)


def is_plain(edges: list[Edge]) -> bool:
    """Whether the lattice has one path."""
    return len({e[0] for e in edges}) == len(edges)


def _logs(edges: list[Edge], freq: dict[str, float], total: float) -> list[float]:
    # an unseen value costs more the longer it is and the more separators it holds; an empty one costs nothing
    unseen = lambda v: -3.0 - 0.7 * len(v) - 3.0 * sum(map(v.count, SEPARATORS))
    held = lambda v: freq.get(v.lower(), 0.0) - DISCOUNT
    return [w + (0.0 if not v else max(math.log(held(v) / total), unseen(v)) if held(v) > 0 else unseen(v)) for _, _, v, w in edges]


def best_path(edges: list[Edge], freq: dict[str, float], total: float) -> list[str]:
    """Values on the likeliest path (Viterbi)."""
    if not edges:
        return []
    order = sorted(range(len(edges)), key=lambda k: (edges[k][0], edges[k][1]))
    logs = _logs(edges, freq, total)
    best: dict[int, tuple[float, int]] = {0: (0.0, -1)}
    for k in order:
        a, b, _, _ = edges[k]
        if a in best:
            s = best[a][0] + logs[k]
            if b not in best or s > best[b][0]:
                best[b] = (s, k)
    at = max(best)
    out = []
    while at:
        k = best[at][1]
        out.append(edges[k][2])
        at = edges[k][0]
    return [v for v in reversed(out) if v]


def expected(edges: list[Edge], freq: dict[str, float], total: float) -> dict[str, float]:
    """Expected number of times each value stands on a path drawn by its likelihood (forward and backward sums)."""
    logs = _logs(edges, freq, total)
    order = sorted(range(len(edges)), key=lambda k: edges[k][0])
    add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -1e300 and y > -1e300 else max(x, y)
    fore: dict[int, float] = {0: 0.0}
    for k in order:
        a, b = edges[k][:2]
        if a in fore:
            fore[b] = add(fore.get(b, -1e301), fore[a] + logs[k])
    last = max(fore)
    back: dict[int, float] = {last: 0.0}
    for k in sorted(range(len(edges)), key=lambda k: -edges[k][0]):
        a, b = edges[k][:2]
        if b in back:
            back[a] = add(back.get(a, -1e301), back[b] + logs[k])
    out: dict[str, float] = {}
    for k, (a, b, v, _) in enumerate(edges):
        if v and a in fore and b in back:
            share = math.exp(min(0.0, fore[a] + logs[k] + back[b] - fore[last]))
            out[v.lower()] = out.get(v.lower(), 0.0) + share
    return out


_EDGES = "array<struct<a:int,b:int,v:string,w:double>>"
_EDGE_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("v", pa.string()), ("w", pa.float64())]))


def _lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values, edges = [], []
        for field in b.column(1).to_pylist():
            e = lattice(field)
            plain = is_plain(e)
            values.append(best_path(e, {}, 1.0) if plain else None)
            edges.append(None if plain else [{"a": x[0], "b": x[1], "v": x[2], "w": x[3]} for x in e])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.list_(pa.string())), pa.array(edges, _EDGE_TYPE)], ["key", "plain", "edges"])


def _scored(task):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from task(b)

    return run


def _expect(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sums: dict[str, float] = {}
    for edges, known, total in zip(*(b.column(c).to_pylist() for c in ("edges", "known", "total")), strict=True):
        freq = {x["v"]: x["n"] for x in known or ()}
        for v, x in expected([(e["a"], e["b"], e["v"], e["w"]) for e in edges], freq, total).items():
            sums[v] = sums.get(v, 0.0) + x
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], ["v", "n"])


def _decide(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = []
    for edges, known, total in zip(*(b.column(c).to_pylist() for c in ("edges", "known", "total")), strict=True):
        freq = {x["v"]: x["n"] for x in known or ()}
        out.append(best_path([(e["a"], e["b"], e["v"], e["w"]) for e in edges], freq, total))
    yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(out, pa.list_(pa.string()))], ["key", "values"])


def unpack(rows: DataFrame, key: str, field: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, pos, value): the values packed in ``field``, in order from 1."""
    kind = dict(rows.dtypes)[key]
    read = rows.filter(F.col(key).isNotNull() & F.col(field).isNotNull()).select(F.col(key).alias("key"), F.col(field).alias("field")).distinct()
    read = stage_table(read.mapInArrow(_lattices, f"key {kind}, plain array<string>, edges {_EDGES}"), "lattices")
    plain = read.filter("plain is not null").select("key", "plain")
    open_rows = read.filter("edges is not null").select("key", "edges").withColumn("row", F.xxhash64("key", "edges.v"))
    seen = plain.select(F.explode("plain").alias("v")).groupBy(F.lower("v").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    seen = stage_table(seen, "values")
    wanted = stage_table(open_rows.select("key", "row", F.explode(F.array_distinct(F.transform("edges.v", lambda v: F.lower(v)))).alias("v")).filter("v <> ''"), "wanted")

    def known(freq: DataFrame) -> DataFrame:
        """Open rows, each with the frequencies of the values that it may hold."""
        total = freq.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("t")).first()["t"] or 1.0
        near = wanted.join(freq, "v").groupBy("key", "row").agg(F.collect_list(F.struct("v", "n")).alias("known"))
        return open_rows.join(near, ["key", "row"], "left").withColumn("total", F.lit(float(total) + 1.0))

    freq = seen
    for _ in range(rounds):
        more = known(freq).select("edges", "known", "total").mapInArrow(_scored(_expect), "v string, n double")
        freq = stage_table(seen.unionByName(more).groupBy("v").agg(F.sum("n").alias("n")), "values")
    decided = known(freq).select("key", "edges", "known", "total").mapInArrow(_scored(_decide), f"key {kind}, values array<string>")
    both = plain.select("key", F.col("plain").alias("values")).union(decided)
    return both.select("key", F.posexplode("values").alias("pos", "value")).select(F.col("key").alias(key), (F.col("pos") + 1).cast("int").alias("pos"), "value")


def found(paper: DataFrame) -> DataFrame:
    """(paper_id, pos, tag) for every tag of every row of paper."""
    return unpack(paper, "paper_id", "tags").withColumnRenamed("value", "tag").distinct()
