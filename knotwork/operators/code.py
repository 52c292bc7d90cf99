"""Static structure of Python repositories: definitions, imports, calls, inheritance, call edges, path contexts.

Facts are extracted file by file in Arrow batches, so a repository that holds a third of all files is spread over all
tasks; everything that needs several files (resolving calls, wildcards, inheritance) is a join of these facts.
"""

from __future__ import annotations

import ast
import warnings
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import stage_table, table

FACT = "repo string, file_id long, kind string, src string, dst string, flavor string, line int"
#: Names of scopes within a function that are no definitions; they are collapsed into what holds them.
INNER = {"Lambda": "lambda", "ListComp": "listcomp", "SetComp": "setcomp", "DictComp": "dictcomp", "GeneratorExp": "genexpr"}
#: How much a flavor tells of a node; of several the most telling one counts.
TELLING = {"module": 1, "name": 1, "class": 2, "function": 2, "method": 3, "staticmethod": 3, "classmethod": 3}
#: Nodes of the shortest and the longest path between two leaves.
SHORTEST, LONGEST = 3, 10


def module_name(path: str) -> str:
    """Dotted name of a file below the first folder; packages are named by their folder."""
    parts = [p for p in path.replace("\\", "/").split("/") if p][1:] or [path.split("/")[-1]]
    parts[-1] = parts[-1].rsplit(".", 1)[0]
    if parts[-1] == "__init__" and len(parts) > 1:
        parts.pop()
    return ".".join(parts)


class _Facts(ast.NodeVisitor):
    """(kind, src, dst, flavor, line) of one module; unresolved attributes of objects are named ``*.attribute``."""

    def __init__(self, module: str) -> None:
        self.module = module
        self.scope = [module]
        self.kinds = ["module"]
        self.names: list[dict[str, str]] = [{}]
        self.out: list[tuple] = []

    def add(self, kind: str, dst: str, flavor: str, node: ast.AST) -> None:
        self.out.append((kind, ".".join(self.scope), dst, flavor, getattr(node, "lineno", 0)))

    def name(self, node: ast.AST) -> str | None:
        """Dotted name of an expression by the innermost binding of its first word."""
        if isinstance(node, ast.Name):
            for level in reversed(self.names):
                if node.id in level:
                    return level[node.id]
            return node.id
        if isinstance(node, ast.Attribute):
            head = self.name(node.value)
            if isinstance(node.value, ast.Name) and node.value.id in ("self", "cls") and "class" in self.kinds:
                last = len(self.kinds) - 1 - self.kinds[::-1].index("class")
                return ".".join([*self.scope[: last + 1], node.attr])
            return f"{head}.{node.attr}" if head and not head.startswith("*") else f"*.{node.attr}"
        if isinstance(node, ast.Call):
            inner = self.name(node.func)
            return inner if inner and inner[:1].isupper() else None
        return None

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.names[-1][a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.add("imports", a.name, "module", node)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = node.module or ""
        if node.level:
            up = self.module.split(".")[: -node.level] or []
            base = ".".join([*up, base] if base else up)
        for a in node.names:
            full = f"{base}.{a.name}" if base else a.name
            if a.name != "*":
                self.names[-1][a.asname or a.name] = full
            self.add("imports", full, "name", node)

    def _enter(self, node, kind: str) -> None:
        for d in node.decorator_list:
            self.visit(d)
        self.scope.append(node.name)
        self.kinds.append(kind)
        # arguments hide names of the same spelling further out
        self.names.append({a: a for a in _arguments(node)} if kind == "function" else {})
        for child in node.body:
            self.visit(child)
        self.names.pop()
        self.kinds.pop()
        self.scope.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        full = ".".join([*self.scope, node.name])
        self.names[-1][node.name] = full
        self.add("defines", full, "class", node)
        for k, b in enumerate(node.bases):
            base = self.name(b)
            if base:
                self.out.append(("inherits", full, base, str(k), node.lineno))
        self._enter(node, "class")

    def visit_FunctionDef(self, node) -> None:
        full = ".".join([*self.scope, node.name])
        marks = {d.id for d in node.decorator_list if isinstance(d, ast.Name)}
        flavor = "function" if self.kinds[-1] != "class" else "staticmethod" if "staticmethod" in marks else "classmethod" if "classmethod" in marks else "method"
        if self.kinds[-1] != "class":
            self.names[-1][node.name] = full
        self.add("defines", full, flavor, node)
        self._enter(node, "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def _inner(self, node) -> None:
        """A lambda or a comprehension: a scope of its own, whose arguments or targets hide outer names."""
        if isinstance(node, ast.Lambda):
            own, parts = _arguments(node), [node.body]
        else:
            own = [n.id for g in node.generators for n in ast.walk(g.target) if isinstance(n, ast.Name)]
            parts = [x for g in node.generators for x in (g.iter, *g.ifs)] + ([node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt])
        self.scope.append(INNER[type(node).__name__])
        self.kinds.append("inner")
        self.names.append({a: a for a in own})
        for x in parts:
            self.visit(x)
        self.names.pop()
        self.kinds.pop()
        self.scope.pop()

    visit_Lambda = visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = _inner

    def visit_Name(self, node: ast.Name) -> None:
        """A name that is read and bound here to something else of the program is a use of it."""
        full = self.name(node)
        if isinstance(node.ctx, ast.Load) and full and full != node.id:
            self.add("uses", full, "name", node)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        full = self.name(node)
        if isinstance(node.ctx, ast.Load) and full and not full.startswith("*"):
            self.add("uses", full, "attribute", node)
        else:
            self.visit(node.value)

    def bind(self, target: ast.AST, value: ast.AST | None) -> None:
        """Let a target name what a value names, pair by pair for tuples; anything else unbinds the names of the target."""
        if isinstance(target, ast.Name):
            full = self.name(value) if value is not None else None
            if full and not isinstance(value, ast.Call) or (full and full[:1].isupper()):
                self.names[-1][target.id] = full
            else:
                self.names[-1].pop(target.id, None)
        elif isinstance(target, (ast.Tuple, ast.List)):
            same = isinstance(value, (ast.Tuple, ast.List)) and len(value.elts) == len(target.elts) and not any(isinstance(x, ast.Starred) for x in (*value.elts, *target.elts))
            for k, t in enumerate(target.elts):
                self.bind(t, value.elts[k] if same else None)
        elif isinstance(target, ast.Starred):
            self.bind(target.value, None)
        else:
            self.visit(target)

    def visit_Assign(self, node: ast.Assign) -> None:
        self.visit(node.value)
        for t in node.targets:
            self.bind(t, node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self.visit(node.annotation)
        if node.value is not None:
            self.visit(node.value)
            self.bind(node.target, node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self.visit(node.value)
        self.bind(node.target, None)

    def visit_For(self, node) -> None:
        self.visit(node.iter)
        self.bind(node.target, None)
        for x in (*node.body, *node.orelse):
            self.visit(x)

    visit_AsyncFor = visit_For

    def visit_Call(self, node: ast.Call) -> None:
        callee = self.name(node.func)
        if callee == "super":
            callee = None
        if callee:
            self.add("calls", callee, str(len(node.args)), node)
            for k, a in enumerate(node.args):
                if isinstance(a, ast.Constant):
                    self.out.append((f"has_arg_{k}", callee, repr(a.value), "arg", node.lineno))
            for kw in node.keywords:
                if kw.arg and isinstance(kw.value, ast.Constant):
                    self.out.append((f"has_keyword_{kw.arg}", callee, repr(kw.value.value), "keyword", node.lineno))
        self.generic_visit(node)

    def visit_With(self, node) -> None:
        for item in node.items:
            manager = self.name(item.context_expr.func) if isinstance(item.context_expr, ast.Call) else self.name(item.context_expr)
            if manager:
                self.add("calls", f"{manager}.__enter__", "with", node)
                self.add("calls", f"{manager}.__exit__", "with", node)
        self.generic_visit(node)

    visit_AsyncWith = visit_With


def _arguments(node) -> list[str]:
    a = node.args
    return [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg)))]


def parsed(code: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _facts_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[tuple] = []
        for repo, fid, path, code in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            tree = parsed(code)
            if tree is not None:
                v = _Facts(module_name(path))
                try:
                    v.visit(tree)
                except RecursionError:
                    continue
                rows += [(repo, fid, *r) for r in v.out]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["repo", "file_id", "kind", "src", "dst", "flavor", "line"])


def facts(repo: DataFrame, inner: bool = False) -> DataFrame:
    """Facts of all Python files that parse: (repo, file_id, kind, src, dst, flavor, line).

    Lambdas and comprehensions are scopes; unless ``inner`` is wanted their facts go to the function or module around them.
    """
    files = repo.filter(F.lower("code_path").endswith(".py") & F.col("code").isNotNull()).select("stored_dir_name", "file_id", "code_path", "code")
    found = files.mapInArrow(_facts_task, FACT)
    return found if inner else collapsed(found)


def collapsed(found: DataFrame) -> DataFrame:
    """Facts with the names of lambdas and comprehensions at the end of their source taken off."""
    return found.withColumn("src", F.regexp_replace("src", rf"(?:\.(?:{'|'.join(INNER.values())}))+$", ""))


def nodes(found: DataFrame) -> DataFrame:
    """(repo, name, flavor): every definition, module and class that facts name, with the most telling flavor it has."""
    weight = F.create_map(*(F.lit(x) for kv in TELLING.items() for x in kv))
    named = found.filter("kind = 'defines'").select("repo", F.col("dst").alias("name"), "flavor").union(found.filter("kind in ('defines', 'imports')").select("repo", F.split_part("src", F.lit("."), F.lit(1)), F.lit("name")))
    named = named.union(found.filter("kind = 'inherits'").select("repo", "dst", F.lit("class")))
    return named.groupBy("repo", "name").agg(F.max_by("flavor", F.struct(F.coalesce(F.try_element_at(weight, F.col("flavor")), F.lit(0)), "flavor")).alias("flavor"))


def between_flavors(edges: DataFrame, known: DataFrame, dropped: tuple[str, ...] = ("name",)) -> DataFrame:
    """Edges whose two ends are known nodes of a flavor that is not dropped."""
    side = lambda c: known.filter(~F.col("flavor").isin(*dropped)).select("repo", F.col("name").alias(c))
    return edges.join(side("src"), ["repo", "src"], "left_semi").join(side("dst"), ["repo", "dst"], "left_semi")


def without_wildcards(edges: DataFrame) -> DataFrame:
    """Edges without those to ``*.name`` from a source that reaches the same name in full."""
    short = F.substring_index("dst", ".", -1)
    full = edges.filter("not startswith(dst, '*.')").select("repo", "src", short.alias("short")).distinct()
    wild = edges.filter("startswith(dst, '*.')").withColumn("short", short).join(full, ["repo", "src", "short"], "left_anti").drop("short")
    return edges.filter("not startswith(dst, '*.')").unionByName(wild.select(*edges.columns))


def culled(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Edges without those to ``Base.name`` from a source that also reaches ``Child.name`` of a class derived from that base."""
    above = found.filter("kind = 'inherits'").select("repo", F.col("src").alias("child"), F.col("dst").alias("base")).distinct()
    short = F.substring_index("dst", ".", -1)
    parts = edges.withColumn("short", short).withColumn("owner", F.expr("left(dst, greatest(length(dst) - length(short) - 1, 0))"))
    lower = parts.select("repo", "src", "short", F.col("owner").alias("child")).join(above, ["repo", "child"]).select("repo", "src", "short", F.col("base").alias("owner")).distinct()
    return parts.join(lower, ["repo", "src", "short", "owner"], "left_anti").select(*edges.columns)


def constructor_edges(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(repo, src, dst) of calls of a class to the ``__init__`` that its class or the first of its C3 order defines."""
    defined = found.filter("kind = 'defines'").select("repo", F.col("dst").alias("full"), "flavor").distinct()
    made = edges.join(defined.filter("flavor = 'class'").select("repo", F.col("full").alias("dst")), ["repo", "dst"], "left_semi").select("repo", "src", F.col("dst").alias("cls")).distinct()
    line = resolution_orders(found).select("repo", "cls", "base", (F.col("place") + 1).alias("place")).unionByName(made.select("repo", "cls", F.col("cls").alias("base"), F.lit(0).alias("place")).distinct())
    init = line.withColumn("full", F.concat("base", F.lit(".__init__"))).join(defined.select("repo", "full"), ["repo", "full"], "left_semi").groupBy("repo", "cls").agg(F.min_by("full", "place").alias("dst"))
    return made.join(init, ["repo", "cls"]).select("repo", "src", "dst").distinct()


def resolution_orders(found: DataFrame) -> DataFrame:
    """(repo, cls, base, place): the method resolution order of every class with bases, the class itself left out."""
    bases = found.filter("kind = 'inherits'").select("repo", F.col("src").alias("node"), F.col("flavor").cast("int").alias("k"), F.col("dst").alias("base")).distinct()
    return _resolution_orders(bases.select("repo", F.col("node").alias("cls")).distinct(), bases)


def star_targets(found: DataFrame) -> DataFrame:
    """(repo, module, target, way): modules whose names ``from m import *`` brings into a module, through modules that do the same.

    The least ``way`` binds: the latest import first, what a module defines before what it imports.
    """
    direct = found.filter("kind = 'imports' and dst like '%.*'").select("repo", F.col("src").alias("module"), F.expr("left(dst, length(dst) - 2)").alias("target"), F.array(-F.col("line")).alias("way"))
    direct = stage_table(direct.groupBy("repo", "module", "target").agg(F.min("way").alias("way")), "stars")
    seen = front = direct
    while not front.isEmpty():
        on = direct.select("repo", F.col("module").alias("target"), F.col("target").alias("next"), F.col("way").alias("step"))
        step = front.join(on, ["repo", "target"]).filter("next <> module").groupBy("repo", "module", F.col("next").alias("target")).agg(F.min(F.concat("way", "step")).alias("way"))
        front = stage_table(step.join(seen, ["repo", "module", "target"], "left_anti"), "stars")
        seen = seen.unionByName(front)
    return seen


def _starred(names: DataFrame, stars: DataFrame, defined: DataFrame) -> DataFrame:
    """(repo, file_id, dst, full) of names that no file defines and that a star import binds in their file or in the module they name."""
    files = names.select("repo", "file_id", "module").distinct().join(stars, ["repo", "module"]).select("repo", "file_id", "target", "way")
    bare = names.join(files, ["repo", "file_id"]).select("repo", "file_id", "dst", F.concat("target", F.lit("."), "dst").alias("full"), "way")
    parts = F.split("dst", r"\.")
    heads = names.filter(F.contains("dst", F.lit("."))).select("repo", "file_id", "dst", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k"))
    heads = heads.select("repo", "file_id", "dst", F.expr("substring_index(dst, '.', k)").alias("module"), F.expr("substring(dst, length(substring_index(dst, '.', k)) + 2)").alias("rest"))
    dotted = heads.join(stars, ["repo", "module"]).select("repo", "file_id", "dst", F.concat("target", F.lit("."), "rest").alias("full"), "way")
    met = bare.unionByName(dotted).join(defined.select("repo", "full"), ["repo", "full"], "left_semi")
    return met.groupBy("repo", "file_id", "dst").agg(F.min_by("full", F.struct("way", "full")).alias("full"))


def _resolution_orders(wanted: DataFrame, bases: DataFrame) -> DataFrame:
    """(repo, cls, base, place): the bases of the wanted classes in C3 order; only what lies above these classes is gathered."""
    bases = stage_table(bases, "bases")
    front = stage_table(wanted.select("repo", "cls", F.col("cls").alias("node")).distinct(), "above")
    seen = front
    while not front.isEmpty():
        step = front.join(bases, ["repo", "node"]).select("repo", "cls", F.col("base").alias("node")).distinct()
        front = stage_table(step.join(seen, ["repo", "cls", "node"], "left_anti"), "above")
        seen = seen.unionByName(front)
    above = seen.join(bases, ["repo", "node"]).groupBy("repo", "cls").agg(F.collect_list(F.struct("node", "k", "base")).alias("edges"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for repo, cls, edges in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                parents: dict[str, list[str]] = {}
                for e in sorted(edges, key=lambda e: (e["node"], e["k"], e["base"])):
                    if e["base"] not in parents.setdefault(e["node"], []):
                        parents[e["node"]].append(e["base"])
                rows += [(repo, cls, base, place) for place, base in enumerate(linearize(parents, cls)[1:])]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["repo", "cls", "base", "place"])

    return above.mapInArrow(task, "repo string, cls string, base string, place int")


def _resolved(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls as (repo, src, dst, how, short), ``how`` null where only the short name is known, and definitions (repo, full, short)."""
    found = stage_table(found.filter("kind in ('calls', 'defines', 'inherits', 'imports')"), "facts")
    defined = stage_table(found.filter("kind = 'defines'").select("repo", F.col("dst").alias("full")).distinct().withColumn("short", F.substring_index("full", ".", -1)), "defined")
    known = defined.select("repo", F.col("full").alias("dst"))
    stars = star_targets(found)
    modules = found.filter("kind = 'imports' and dst like '%.*'").select("repo", "file_id", F.col("src").alias("module")).distinct()
    named = found.filter("kind in ('calls', 'inherits') and not startswith(dst, '*.')").select("repo", "file_id", "dst").distinct().join(known, ["repo", "dst"], "left_anti")
    starred = stage_table(_starred(named.join(modules, ["repo", "file_id"], "left"), stars, defined), "starred")

    inherits = found.filter("kind = 'inherits'").select("repo", "file_id", "src", "dst", "flavor").withColumnRenamed("src", "node")
    bases = inherits.join(starred, ["repo", "file_id", "dst"], "left").select("repo", "node", F.col("flavor").cast("int").alias("k"), F.coalesce("full", "dst").alias("base")).distinct()

    calls = found.filter("kind = 'calls'").select("repo", "file_id", "src", "dst").distinct().join(starred, ["repo", "file_id", "dst"], "left")
    exact = calls.join(known, ["repo", "dst"], "left_semi").select("repo", "src", "dst", F.lit("exact").alias("how"))
    star = calls.filter("full is not null").select("repo", "src", F.col("full").alias("dst"), F.lit("star").alias("how"))
    rest = calls.filter("full is null").select("repo", "src", "dst").distinct().join(known, ["repo", "dst"], "left_anti").withColumn("short", F.substring_index("dst", ".", -1))

    # C.name where C is a class that does not define name: the first class of its order that does
    owned = rest.withColumn("cls", F.expr("left(dst, greatest(length(dst) - length(short) - 1, 0))"))
    aims = owned.select("repo", "cls", "short").distinct().join(bases.select("repo", F.col("node").alias("cls")).distinct(), ["repo", "cls"], "left_semi")
    above = aims.join(_resolution_orders(aims, bases), ["repo", "cls"]).withColumn("full", F.concat("base", F.lit("."), "short"))
    first = above.join(defined.select("repo", "full"), ["repo", "full"], "left_semi").groupBy("repo", "cls", "short").agg(F.min_by("full", "place").alias("full"))
    rest = stage_table(owned.join(first, ["repo", "cls", "short"], "left"), "rest")
    inherited = rest.filter("full is not null").select("repo", "src", F.col("full").alias("dst"), F.lit("inherited").alias("how"))

    # a bare name, or one below a module, class or function of the repository, is contracted; what hangs on other names is not
    inner = found.filter("kind = 'defines'").select("repo", F.col("src").alias("cls")).union(defined.select("repo", "full")).distinct().withColumn("inner", F.lit(True))
    left = rest.filter("full is null").select("repo", "src", "dst", "short", "cls").join(inner, ["repo", "cls"], "left").withColumn("open", F.startswith("dst", F.lit("*.")) | (F.col("cls") == "") | F.col("inner").isNotNull())
    left = left.join(defined.select("repo", "short").distinct().withColumn("met", F.lit(True)), ["repo", "short"], "left").withColumn("met", F.col("open") & F.col("met").isNotNull())
    how = F.when(~F.col("met"), F.when(F.startswith("dst", F.lit("*.")), "unknown").otherwise("external"))
    left = left.select("repo", "src", "dst", how.alias("how"), "short")
    done = exact.unionByName(star).unionByName(inherited).withColumn("short", F.substring_index("dst", ".", -1))
    return done.unionByName(left).distinct(), defined


def call_graph(found: DataFrame) -> DataFrame:
    """(repo, src, dst, how): call edges between definitions of a repository.

    A callee that is defined under its full name gives an ``exact`` edge; a name bound by ``from m import *`` one to the
    definition in ``m`` (``star``); an attribute that a class does not define one to the first class of its C3 order that
    does (``inherited``). One whose end only is known (``*.name``, or an undefined name that is bare or below a module, class
    or function of the repository) meets every definition of that short name (``expanded``). What else is undefined,
    such as attributes of variables and of modules that are not there, stays as it is, ``unknown`` or ``external``.
    Edges repeat no more than once; the short names are distinct on the side that is looked up.
    """
    edges, defined = _resolved(found)
    told = edges.filter("how is not null").select("repo", "src", "dst", "how")
    wild = edges.filter("how is null").select("repo", "src", "short").distinct().join(defined, ["repo", "short"]).select("repo", "src", F.col("full").alias("dst"), F.lit("expanded").alias("how"))
    return told.unionByName(wild).distinct()


def edge_counts(found: DataFrame) -> DataFrame:
    """(repo, how, n): edges of :func:`call_graph`; a caller of a short name counts once per definition without making the pairs."""
    edges, defined = _resolved(found)
    told = edges.filter("how is not null").groupBy("repo", "how").agg(F.count(F.lit(1)).alias("n"))
    many = defined.groupBy("repo", "short").agg(F.count(F.lit(1)).alias("n"))
    wild = edges.filter("how is null").groupBy("repo", "short").agg(F.count_distinct("src").alias("callers")).join(many, ["repo", "short"])
    return told.unionByName(wild.groupBy("repo", F.lit("expanded").alias("how")).agg(F.sum(F.col("callers") * F.col("n")).alias("n")))


def linearize(bases: dict[str, list[str]], name: str, seen: tuple[str, ...] = ()) -> list[str]:
    """Method resolution order of a class by C3, depth first where C3 has none."""
    if name in seen:
        return [name]
    parents = bases.get(name, [])
    lines = [linearize(bases, p, (*seen, name)) for p in parents] + [list(parents)]
    out = [name]
    while lines := [x for x in lines if x]:
        head = next((x[0] for x in lines if not any(x[0] in y[1:] for y in lines)), None)
        if head is None:
            return list(dict.fromkeys([name, *(c for p in parents for c in linearize(bases, p, (*seen, name)))]))
        out.append(head)
        lines = [[y for y in x if y != head] for x in lines]
    return out


def _fields(node: ast.AST) -> tuple[list[str], list[ast.AST]]:
    """Plain field values of a node, which are its leaves, and the nodes below it; texts that document go."""
    values, below = [], []
    for _, value in ast.iter_fields(node):
        for x in value if isinstance(value, list) else [value] if value is not None else []:
            if not isinstance(x, ast.AST):
                values.append(repr(x) if isinstance(node, ast.Constant) else str(x))
            elif not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)):
                below.append(x)
    return values, below


def _leaves(node: ast.AST, trail: tuple) -> Iterator[tuple[str, tuple]]:
    here = (*trail, (id(node), type(node).__name__))
    values, below = _fields(node)
    for value in values:
        yield value, here
    for child in below:
        yield from _leaves(child, here)


def _path(up: Iterable[str], down: Iterable[str]) -> str:
    return "_".join(["^".join(up), *down])


def path_contexts(tree: ast.Module) -> Iterator[tuple[str, str, str, str]]:
    """(function, left, path, right) of leaf pairs of every function, in both directions, whose path has an allowed length."""
    for f in ast.walk(tree):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for (left, a), (right, b) in combinations(_leaves(f, ()), 2):
                same = 0
                while same < min(len(a), len(b)) and a[same] == b[same]:
                    same += 1
                if SHORTEST <= len(a) + len(b) - 2 * same + 1 <= LONGEST:
                    x, y = [n for _, n in a[same - 1 :]], [n for _, n in b[same - 1 :]]
                    yield f.name, left, _path(reversed(x), y[1:]), right
                    yield f.name, right, _path(reversed(y), x[1:]), left


def path_counts(tree: ast.Module) -> Counter[str]:
    """How often each path of :func:`path_contexts` stands in a module.

    Leaves with the same node types between them and a common parent are counted together, so pairs are multiplied
    instead of made; a pair counts once for every function around it.
    """
    counts: Counter[tuple] = Counter()
    done: dict[int, Counter[tuple]] = {}  # types from a leaf up to the node
    stack: list[tuple] = [(tree, 0, None)]
    while stack:
        node, around, below = stack.pop()
        if below is None:
            around += isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef))
            values, below = _fields(node)
            stack.append((node, around, (len(values), below)))
            stack += [(x, around, None) for x in below]
            continue
        size, below = below
        name = type(node).__name__
        held: Counter[tuple] = Counter({(): size} if size else {})
        for x in below:
            own = done.pop(id(x), Counter())  # nodes without fields, such as Load, are shared and hold no leaf
            if around:
                for p, n in own.items():
                    for q, m in held.items():
                        if SHORTEST <= len(p) + len(q) + 1 <= LONGEST:
                            counts[q, name, p] += n * m * around
                            counts[p, name, q] += n * m * around
            held.update(own)
        done[id(node)] = Counter({(*p, name): n for p, n in held.items() if len(p) + 1 < LONGEST})
    out: Counter[str] = Counter()
    for (p, name, q), n in counts.items():
        out[_path((*p, name), reversed(q))] += n
    return out


def context_counts(repo: DataFrame) -> DataFrame:
    """(path, n): how often each path between leaves stands in functions; counts are made in the task before the shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter[str] = Counter()
            for code in b.column(0).to_pylist():
                tree = parsed(code)
                if tree is not None:
                    counts.update(path_counts(tree))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["path", "n"])

    files = repo.filter(F.lower("code_path").endswith(".py") & F.col("code").isNotNull()).select("code")
    return files.mapInArrow(task, "path string, n long").groupBy("path").agg(F.sum("n").alias("n"))


def function_lines(repo: DataFrame) -> DataFrame:
    """(file_id, name, words): functions as word lists for document vectors, the first word being the name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for fid, code in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                tree = parsed(code)
                for f in ast.walk(tree) if tree is not None else ():
                    if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        names = [n.id if isinstance(n, ast.Name) else n.attr for n in ast.walk(f) if isinstance(n, (ast.Name, ast.Attribute))]
                        rows.append((fid, f.name, " ".join([f.name, *names])))
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["file_id", "name", "words"])

    files = repo.filter(F.lower("code_path").endswith(".py") & F.col("code").isNotNull()).select("file_id", "code")
    return files.mapInArrow(task, "file_id long, name string, words string")


def api_score(key: str, name: str) -> float:
    """How well a dotted call fits a name of an API vocabulary; 0 if their last words differ in more than case.

    The last words count most: 6 points for equal, 3 for equal but for case, shared over the length of the name; each
    further word of the call gains or loses by its place in the name.
    """
    mine, other = key.split(".")[::-1], name.split(".")[::-1]
    n = len(other)
    fit = lambda x, y: 6.0 if x == y else 3.0 if x.lower() == y.lower() else 0.0
    score = fit(mine[0], other[0]) / n
    if not score:
        return 0.0
    for x in mine[1:]:
        for k, y in enumerate(other[1:], 2):
            score += (fit(x, y) or -6.0) / k / n
    return max(score, 0.0)


def api_matches(calls: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(call, name, score): the best vocabulary name of each distinct call, met by equal last words; ties by name."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [api_score(c, n) for c, n in zip(b.column("call").to_pylist(), b.column("name").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("call"), b.column("name"), pa.array(s, pa.float64())], ["call", "name", "score"])

    last = lambda c: F.lower(F.substring_index(c, ".", -1)).alias("last")
    met = calls.select("call", last("call")).distinct().join(vocabulary.select("name", last("name")).distinct(), "last").select("call", "name")
    scored = met.mapInArrow(task, "call string, name string, score double").filter("score > 0")
    best = scored.groupBy("call").agg(F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("b"))
    return best.select("call", F.col("b.name").alias("name"), F.round(-F.col("b.s"), 6).alias("score"))


def _plain_calls(repo: DataFrame) -> DataFrame:
    return facts(repo).filter("kind = 'calls'").select("repo", "src", "dst").distinct()


def queries() -> dict:
    repo = lambda s, d: table(s, d, "repo")
    return {
        "code_definitions": lambda s, d: facts(repo(s, d)).filter("kind = 'defines'").select("repo", "file_id", "src", "dst", "flavor", "line").distinct(),
        "code_nodes": lambda s, d: nodes(facts(repo(s, d))),
        "code_uses": lambda s, d: facts(repo(s, d)).filter("kind = 'uses'").groupBy("repo", "src", "dst").agg(F.count(F.lit(1)).alias("n")),
        "code_inner_scopes": lambda s, d: facts(repo(s, d), inner=True).filter(F.rlike("src", F.lit(rf"\.(?:{'|'.join(INNER.values())})$"))).select("repo", "file_id", "kind", "src", "dst", "line").distinct(),
        "code_resolution_orders": lambda s, d: resolution_orders(facts(repo(s, d))),
        "code_constructors": lambda s, d: constructor_edges(_plain_calls(repo(s, d)), facts(repo(s, d))),
        "code_culled_calls": lambda s, d: culled(without_wildcards(_plain_calls(repo(s, d))), facts(repo(s, d))),
        "code_known_calls": lambda s, d: between_flavors(_plain_calls(repo(s, d)), nodes(facts(repo(s, d)))),
        "code_call_graph": lambda s, d: edge_counts(facts(repo(s, d))),
        "code_imports": lambda s, d: facts(repo(s, d)).filter("kind = 'imports'").select("repo", "file_id", F.col("dst").alias("module"), "flavor").distinct(),
        "code_arguments": lambda s, d: facts(repo(s, d)).filter(F.startswith("kind", F.lit("has_"))).groupBy("kind", F.col("src").alias("call")).agg(F.count(F.lit(1)).alias("n")),
        "code_path_contexts": lambda s, d: context_counts(repo(s, d)),
        "code_function_lines": lambda s, d: function_lines(repo(s, d)),
        "code_api_matches": lambda s, d: api_matches(
            facts(repo(s, d)).filter("kind = 'calls'").select(F.regexp_replace("dst", r"^\*\.", "").alias("call")),
            facts(repo(s, d)).filter("kind in ('imports', 'calls') and contains(dst, '.') and not startswith(dst, '*')").select(F.col("dst").alias("name")),
        ),
    }


def oracle_sql() -> dict[str, str]:
    return {}
