"""Basic graph patterns over triples, planned for property tables.

A graph is a set of tables. A **property table** has one row per subject and a column per single-valued predicate; an
**edge table** has one predicate with any number of objects. A pattern group is planned in three steps:

* patterns of one subject that some property table answers become one scan of that table with its columns, instead of
  a self-join per pattern (subject name spaces of tables are disjoint, so only tables that have all the predicates of
  the subject can answer);
* constants and filters on a variable go into the scan that binds it, where Catalyst pushes them to the files;
* the remaining relations are joined along shared variables, starting from the one with most constants, so no plan
  has a cross product unless the pattern itself is disconnected, which is refused.

Scans of edge tables are distinct (a graph is a set); bindings are a bag, so counts keep their fan-out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class PropertyTable:
    """One row per subject: ``columns`` gives the object of each predicate (null: no triple).

    ``owners`` gives, for predicates of which a subject of this table is the object exactly once, the subject of that triple;
    a pattern of such a predicate is then answered by the scan of the star itself, without its edge table.
    """

    rows: Callable[[], DataFrame]
    subject: Column
    columns: dict[str, Column]
    prefix: str = ""
    owners: dict[str, Column] = field(default_factory=dict)


@dataclass
class EdgeTable:
    """Triples of one predicate as columns ``s`` and ``o``.

    ``owners`` names further columns of the rows: for a predicate of which a subject of this table is the object exactly once,
    the subject of that triple, as for property tables.
    """

    predicate: str
    rows: Callable[[], DataFrame]
    prefix: str = ""
    is_set: bool = False
    owners: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Pattern:
    """A triple pattern; terms that begin with ``?`` are variables. ``star`` asks for a path of zero or more steps."""

    s: str
    p: str
    o: str
    star: bool = False


def is_var(term: str) -> bool:
    return term.startswith("?")


@dataclass
class Graph:
    properties: Sequence[PropertyTable] = ()
    edges: Sequence[EdgeTable] = ()
    namespaces: dict[str, str] = field(default_factory=dict)
    #: Name space of the objects of a predicate, where all its objects have one.
    ranges: dict[str, str] = field(default_factory=dict)

    def triples(self, predicate: str | None = None) -> DataFrame:
        """All triples, or those of one predicate, as columns s, p, o without repetition."""
        parts = []
        for t in self.properties:
            rows = t.rows()
            for p, c in t.columns.items():
                if predicate in (None, p):
                    parts.append(rows.select(t.subject.alias("s"), F.lit(p).alias("p"), c.cast("string").alias("o")).filter("o is not null"))
        for e in self.edges:
            if predicate in (None, e.predicate):
                rows = e.rows().select("s", F.lit(e.predicate).alias("p"), F.col("o").cast("string").alias("o")).filter("s is not null and o is not null")
                parts.append(rows if e.is_set else rows.distinct())
        if not parts:
            raise KeyError(f"no triples of {predicate}")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out if predicate and len(parts) == 1 else out.distinct()

    def predicate_counts(self) -> DataFrame:
        """(p, n): triples per predicate. A property table is read once for all its predicates.

        Counts of tables are added where their subjects lie in different name spaces; else the triples are made distinct.
        """
        spaces: dict[str, list[str]] = {}
        for t in [*self.properties, *self.edges]:
            for p in t.columns if isinstance(t, PropertyTable) else (t.predicate,):
                spaces.setdefault(p, []).append(t.prefix)
        mixed = {p for p, x in spaces.items() if len(x) > 1 and any(not a or any(b.startswith(a) for b in x[k + 1 :]) or any(a.startswith(b) for b in x[k + 1 :]) for k, a in enumerate(x))}
        parts = []
        for t in self.properties:
            own = {p: c for p, c in t.columns.items() if p not in mixed}
            if own:
                counts = t.rows().agg(*(F.count(F.when(t.subject.isNotNull(), c)).alias(p) for p, c in own.items()))
                parts.append(counts.select(F.explode(F.create_map(*(x for p in own for x in (F.lit(p), F.col(p))))).alias("p", "n")))
        for e in self.edges:
            if e.predicate not in mixed:
                rows = e.rows().select("s", "o").filter("s is not null and o is not null")
                parts.append((rows if e.is_set else rows.distinct()).agg(F.count(F.lit(1)).alias("n")).select(F.lit(e.predicate).alias("p"), "n"))
        parts += [self.triples(p).groupBy("p").agg(F.count(F.lit(1)).alias("n")) for p in sorted(mixed)]
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out.groupBy("p").agg(F.sum("n").alias("n")).filter("n > 0")

    def match(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """Triples with any of subject, predicate and object given."""
        out = self.triples(p)
        for name, value in (("s", s), ("o", o)):
            if value is not None:
                out = out.filter(F.col(name) == value)
        return out


def _scan_star(table: PropertyTable, subject: str, group: list[Pattern], filters: dict[str, list[Callable[[Column], Column]]], owned: Sequence[Pattern] = ()) -> DataFrame:
    rows = table.rows()
    columns: dict[str, Column] = {}
    conditions = []
    if is_var(subject):
        columns[subject] = table.subject
    else:
        conditions.append(table.subject == subject)
    for q in group:
        value = table.columns[q.p].cast("string")
        conditions.append(value.isNotNull())
        if not is_var(q.o):
            conditions.append(value == q.o)
        elif q.o in columns:
            conditions.append(columns[q.o] == value)
        else:
            columns[q.o] = value
    for q in owned:
        owner = table.owners[q.p].cast("string")
        conditions.append(owner.isNotNull() if is_var(q.s) and q.s not in columns else owner == (columns[q.s] if is_var(q.s) else q.s))
        if is_var(q.s):
            columns.setdefault(q.s, owner)
    for v, tests in filters.items():
        if v in columns:
            conditions += [t(columns[v]) for t in tests]
    for c in conditions:
        rows = rows.filter(c)
    return rows.select(*(c.alias(v) for v, c in columns.items())) if columns else rows.select(F.lit(1).alias("?"))


def _scan_edge(table: EdgeTable, q: Pattern, filters: dict[str, list[Callable[[Column], Column]]], owned: Sequence[Pattern] = ()) -> DataFrame:
    ends = [("s", q.s), ("o", q.o), *((table.owners[x.p], x.s) for x in owned)]
    rows = table.rows().select(*dict.fromkeys(("s", *(n for n, _ in ends[2:]))), F.col("o").cast("string").alias("o")).filter("s is not null and o is not null")
    out: list[tuple[str, str]] = []
    for name, term in ends:
        same = next((n for n, v in out if v == term), None)
        if same is not None and name != same:
            rows = rows.filter(F.col(name) == F.col(same))
        if not is_var(term):
            rows = rows.filter(F.col(name) == term)
        else:
            for t in filters.get(term, ()):
                rows = rows.filter(t(F.col(name)))
            if term not in [v for _, v in out]:
                out.append((name, term))
    if not table.is_set:
        rows = rows.distinct()
    return rows.select(*(F.col(n).alias(v) for n, v in out))


def bind(graph: Graph, patterns: Sequence[Pattern], filters: dict[str, list[Callable[[Column], Column]]] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """The bag of bindings of a basic graph pattern, one column per variable (of ``keep``, or all)."""
    filters = filters or {}
    patterns = list(dict.fromkeys(patterns))
    relations: list[tuple[int, DataFrame]] = []
    left = list(patterns)
    # a variable that is the object of a predicate with a known range can only be a subject of that name space
    space = {q.o: graph.ranges[q.p] for q in patterns if is_var(q.o) and q.p in graph.ranges}
    fits = lambda t, subject: subject not in space or t.prefix == space[subject]
    for subject in dict.fromkeys(q.s for q in patterns):
        group = [q for q in left if q.s == subject]
        able = [t for t in graph.properties if fits(t, subject) and any(q.p in t.columns for q in group)]
        edge_names = {e.predicate: {x.prefix for x in graph.edges if x.predicate == e.predicate} for e in graph.edges}
        # subjects of a table must be able to have every predicate of the group, there or in an edge table of its name space
        able = [t for t in able if all(q.p in t.columns or t.prefix in edge_names.get(q.p, ()) for q in group)]
        own = [q for q in group if any(q.p in t.columns for t in able)]
        if not own or any(q.p not in t.columns for t in able for q in own):
            continue
        other = [e for e in graph.edges if fits(e, subject) and e.predicate in {q.p for q in own} and all(q.p in {x.predicate for x in graph.edges if x.prefix == e.prefix} for q in group)]
        if other and len(group) == len(own):
            continue
        owned = [q for q in left if q.o == subject and q.s != subject and not q.star and len(able) == 1 and q.p in able[0].owners and is_var(subject)]
        scans = [_scan_star(t, subject, own, filters, owned) for t in able]
        rel = scans[0]
        for x in scans[1:]:
            rel = rel.unionByName(x)
        fixed = sum(not is_var(q.o) or q.o in filters for q in own) + sum(not is_var(q.s) for q in owned) + (not is_var(subject))
        relations.append((fixed, rel))
        left = [q for q in left if q not in own and q not in owned]
    # where one edge table alone answers a pattern, patterns that it owns the object of go with it
    with_owner: dict[Pattern, list[Pattern]] = {}
    for q in left:
        tables = [t for t in graph.properties if q.p in t.columns and fits(t, q.s)] + [e for e in graph.edges if e.predicate == q.p and fits(e, q.s)]
        if len(tables) == 1 and isinstance(tables[0], EdgeTable) and is_var(q.s):
            taken = {x for xs in with_owner.values() for x in xs}
            with_owner[q] = [x for x in left if x.o == q.s and x.s != x.o and not x.star and x.p in tables[0].owners and x not in taken and x not in with_owner]
    gone = {x for xs in with_owner.values() for x in xs}
    for q in left:
        if q in gone:
            continue
        parts = [_scan_star(t, q.s, [q], filters) for t in graph.properties if q.p in t.columns and fits(t, q.s)]
        parts += [_scan_edge(e, q, filters, with_owner.get(q, ())) for e in graph.edges if e.predicate == q.p and fits(e, q.s)]
        if not parts:
            raise KeyError(f"no triples of {q.p}")
        rel = parts[0]
        for x in parts[1:]:
            rel = rel.unionByName(x)
        relations.append(((not is_var(q.s)) + (not is_var(q.o)) + (q.o in filters), rel))
    relations.sort(key=lambda r: -r[0])
    out = relations.pop(0)[1]
    wanted = set(keep) if keep is not None else None
    while relations:
        near = [k for k, (_, r) in enumerate(relations) if set(r.columns) & set(out.columns)]
        if not near:
            raise ValueError("the pattern falls into parts that share no variable")
        _, rel = relations.pop(near[0])
        out = out.join(rel, sorted(set(rel.columns) & set(out.columns)))
        if wanted is not None:
            later = {v for _, r in relations for v in r.columns}
            out = out.select(*(c for c in out.columns if c in wanted or c in later))
    return out
