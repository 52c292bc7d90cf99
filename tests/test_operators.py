import random

import pytest
from pyspark.sql import functions as F

from knotwork.operators import code, figures, graphdef, metrics, tabular, texts


def test_boxes_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for f in range(12):
        for b in range(r.randint(0, 9)):
            x, y = r.randint(0, 200), r.randint(0, 200)
            rows.append((f, b, x, y, x + r.randint(1, 90), y + r.randint(1, 90), r.random()))
    df = spark.createDataFrame(rows, "fig int, box int, x1 int, y1 int, x2 int, y2 int, conf double")
    touch = lambda a, b: not (a[4] < b[2] or a[5] < b[3] or a[2] > b[4] or a[3] > b[5])
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and touch(a, b)}
    got = [tuple(x) for x in figures.overlap_join(df, "fig", "box", 32.0).collect()]
    assert set(got) == want and len(got) == len(want)
    kept = {(x.fig, x.box) for x in figures.suppress(df, "fig", "box", "conf").collect()}
    for f in {x[0] for x in rows}:
        left = sorted((x for x in rows if x[0] == f), key=lambda x: (-x[6], x[1]))
        while left:
            t = left.pop(0)
            assert (f, t[1]) in kept
            inter = lambda o, t=t: max(0, min(t[4], o[4]) - max(t[2], o[2])) * max(0, min(t[5], o[5]) - max(t[3], o[3]))
            gone = [o for o in left if inter(o) > 0.5 * (o[4] - o[2]) * (o[5] - o[3])]
            assert all((f, o[1]) not in kept for o in gone)
            left = [o for o in left if o not in gone]
    merged = figures.merge_pool(df, "fig").collect()
    assert sum(m.merged for m in merged) == len(rows)
    assert not any(a is not b and a.fig == b.fig and not (a.x2 < b.x1 or a.y2 < b.y1 or a.x1 > b.x2 or a.y1 > b.y2) for a in merged for b in merged)
    assert figures.overlap_join(df.limit(0), "fig", "box", 32.0).count() == 0


def test_outer_spans():
    # equal start: the earlier goes; contained: the inner goes; partial overlap: both stay
    assert texts.keep_outer([(1, 0, 5, 5), (2, 0, 9, 9), (3, 2, 4, 2), (4, 8, 12, 4), (5, 20, 22, 2)]) == [2, 4, 5]


def test_dictionary_annotation_against_regex(spark):
    import re

    docs = [(1, "The max pool layers and a pool, dropout."), (2, None), (3, ""), (4, "pooling pools pool")]
    terms = [("pool", "u1"), ("max pool", "u2"), ("dropout", "u3")]
    got = {tuple(r) for r in texts.annotate(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(terms, "term string, uri string"), "doc_id", "text").collect()}
    want = set()
    for d, t in docs:
        hits = [(m.start() + 1, m.end() - 1, u) for w, u in terms for m in re.finditer(rf"(?=\W{w}s?\W)", f" {(t or '').lower()} ") for m in [re.compile(rf"\W{w}s?\W").match(f" {(t or '').lower()} ", m.start())]]
        for k in texts.keep_outer([(i, a, b, b - a) for i, (a, b, _) in enumerate(hits)]):
            a, b, u = hits[k]
            want.add((d, a - 1, b - 1, (t or "").lower()[a - 1 : b - 1], u))
    assert got == want and len(got) == 5


def test_dictionary_annotation_takes_long_terms_and_other_ends(spark):
    docs = [(1, "Dropout (Axial), C++ or one two three four five six seven eight nine tens; .net ++ asp.net")]
    terms = [("dropout (axial)", "u1"), ("c++", "u2"), ("one two three four five six seven eight nine ten", "u3"), (".net", "u4"), ("++", "u5")]
    both = [set(), set()]
    for k, most in enumerate((texts.MOST_TERMS, 0)):  # in the tasks, and by a join
        with pytest.MonkeyPatch.context() as m:
            m.setattr(texts, "MOST_TERMS", most)
            both[k] = {tuple(r) for r in texts.annotate(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(terms, "term string, uri string"), "doc_id", "text").collect()}
    assert both[0] == both[1]
    got = {r[3:] for r in both[0]}
    assert got == {("dropout (axial)", "u1"), ("c++", "u2"), ("one two three four five six seven eight nine tens", "u3"), (".net", "u4"), ("++", "u5")}


def test_abbreviations(spark):
    from pyspark.sql import functions as F

    from knotwork.functions import strings

    rows = [("cnn", "convolutional neural network"), ("cnns", "convolutional neural networks"), ("gan", "recurrent network"), ("a.b", "a big b"), ("long words", "short"), ("s", "some words")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert [r[0] for r in df.select(strings.abbreviates(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False, False]


def test_metrics_on_known_values(spark):
    df = spark.createDataFrame([(0.9, True), (0.8, False), (0.8, True), (0.1, False)], "score double, y boolean")
    assert metrics.auc(df, "score", "y").first()[0] == pytest.approx(0.875)
    assert metrics.average_precision(df, "score", "y").first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-6)
    spans = spark.createDataFrame([(1, 0, 2, "A"), (1, 0, 2, "A"), (1, 3, 4, "B")], "doc int, start int, end int, label string")
    assert tuple(metrics.span_scores(spans, spans.filter("label = 'A'")).first()) == (1.0, 0.5, 0.666667)


def test_upsert_and_update(spark):
    cur = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    new = spark.createDataFrame([("c", 5, 2), ("c", 4, 1), ("a", 9, 0), (None, 7, 0)], "k string, v int, o int")
    assert [tuple(r) for r in tabular.upsert_do_nothing(cur, new, "k", ["o"]).select("k", "v").collect()] == [("c", 4)]
    upd = spark.createDataFrame([("b", 3), ("a", None)], "k string, v int")
    assert sorted(map(tuple, tabular.update_by_key(cur, upd, "k").collect())) == [("a", 1), ("b", 3)]
    bad = spark.createDataFrame([("x", "A"), ("x", "B"), ("y", "A"), ("y", "A"), (None, "A"), ("z", None)], "t string, e string")
    assert [tuple(r) for r in tabular.conflict_free(bad, "t", "e").collect()] == [("y", "A")]
    assert [r[0] for r in spark.createDataFrame([("1,234",), ("x",), (None,)], "s string").select(tabular.stars(F.col("s"))).collect()] == [1234, None, None]


CODE = '''
import numpy as np
from . import helper
from .layers import Dense as D

class Base:
    def run(self):
        return self.step(1)
    def step(self, n): return np.zeros(n)

class Child(Base):
    @staticmethod
    def make(): return Child()
    def go(self):
        with open("x") as f:
            D(3, 4, 5, name="d").run()
        x: int = 4
        return helper.load(self)
'''


def test_code_facts(spark):
    rows = [("r", 1, "root/pkg/mod.py", CODE), ("r", 2, "root/pkg/helper.py", "def load(x):\n    return x.go()\n"), ("r", 3, "root/bad.py", "def f(:"), ("r", 4, "root/none.py", None)]
    facts = code.facts(spark.createDataFrame(rows, "stored_dir_name string, file_id long, code_path string, code string"))
    have = {(r.kind, r.src, r.dst) for r in facts.collect()}
    assert {("defines", "pkg.mod", "pkg.mod.Child"), ("inherits", "pkg.mod.Child", "pkg.mod.Base"), ("calls", "pkg.mod.Base.run", "pkg.mod.Base.step"), ("calls", "pkg.mod.Child.go", "pkg.helper.load")} <= have
    assert ("calls", "pkg.mod.Child.go", "open.__enter__") in have and ("has_arg_0", "pkg.layers.Dense", "3") in have
    graph = {(r.src, r.dst, r.how) for r in code.call_graph(facts).collect()}
    assert ("pkg.mod.Child.go", "pkg.helper.load", "exact") in graph and ("pkg.helper.load", "pkg.mod.Child.go", "expanded") not in graph
    assert ("pkg.mod.Base.step", "numpy.zeros", "external") in graph


def test_calls_through_bases_stars_and_short_names(spark):
    files = {
        "root/base.py": "class Base:\n    def run(self): pass\n    def stop(self): pass\nclass Mixin:\n    def run(self): pass\ndef tool(): pass\n",
        "root/mid.py": "from base import *\nclass Mid(Base): pass\n",
        "root/top.py": "from mid import *\nclass Top(Mixin, Mid):\n    def go(self):\n        self.run()\n        self.stop()\n        tool()\n        lone()\n        self.step()\n        print(1)\n",
        "root/lone.py": "def lone(): pass\ndef step(): pass\n",
    }
    rows = [("r", k, path, text) for k, (path, text) in enumerate(files.items())]
    facts = code.facts(spark.createDataFrame(rows, "stored_dir_name string, file_id long, code_path string, code string"))
    got = {(r.src, r.dst, r.how) for r in code.call_graph(facts).collect()}
    assert got == {
        ("top.Top.go", "base.Mixin.run", "inherited"), ("top.Top.go", "base.Base.stop", "inherited"), ("top.Top.go", "base.tool", "star"),
        ("top.Top.go", "lone.lone", "expanded"), ("top.Top.go", "lone.step", "expanded"), ("top.Top.go", "print", "external"),
    }
    assert {(r.how, r.n) for r in code.edge_counts(facts).collect()} == {("inherited", 2), ("star", 1), ("expanded", 2), ("external", 1)}


def test_resolution_order():
    bases = {"D": ["B", "C"], "B": ["A"], "C": ["A"], "A": []}
    assert code.linearize(bases, "D") == ["D", "B", "C", "A"]
    assert code.linearize({"X": ["X"]}, "X")[0] == "X"


def test_path_contexts_have_bounds():
    import ast

    got = list(code.path_contexts(ast.parse("def f(a, b):\n    'text'\n    return a + b\n")))
    assert ("f", "a", "Name^BinOp_Name", "b") in got and not any("text" in x for c in got for x in (c[1], c[3]))
    assert all(code.SHORTEST <= len(p.replace("_", "^").split("^")) <= code.LONGEST for _, _, p, _ in got)


def test_path_contexts_against_brute_force():
    import ast
    from collections import Counter
    from itertools import combinations

    text = "@d\nclass A:\n  async def f(s, a, *, k, b=None):\n    'text'\n    from m import x as y\n    def g(q):\n      global z\n      return {**q, 'u': a.b.c}\n    return s.run(g(a), key=[b + 1.5, None])\n"

    def leaves(node, path):
        path = [*path, node]
        items = [x for _, v in ast.iter_fields(node) for x in (v if isinstance(v, list) else [] if v is None else [v])]
        here = [(x, path) for x in items if not isinstance(x, ast.AST)]
        return here + [y for x in items if isinstance(x, ast.AST) for y in leaves(x, path)]

    want = Counter()
    for f in ast.walk(ast.parse(text)):
        if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for (_, a), (_, b) in combinations(leaves(f, []), 2):
                if any(isinstance(p[-2], ast.Expr) and p[-1].value == "text" for p in (a, b) if len(p) > 1):
                    continue
                k = max(i for i in range(min(len(a), len(b))) if a[i] is b[i])
                path = [type(x).__name__ for x in a[k + 1 :][::-1] + b[k:]]
                if code.SHORTEST <= len(path) <= code.LONGEST:
                    want.update(["_".join(path), "_".join(path[::-1])])
    tree, flat = ast.parse(text), Counter()
    for path, n in code.path_counts(tree).items():
        flat[path.replace("^", "_")] += n
    assert flat == want
    got = list(code.path_contexts(tree))
    assert Counter(x[2] for x in got) == code.path_counts(tree)
    assert ("f", "c", "Attribute^Attribute^Attribute_Name", "a") not in got and ("g", "b", "Attribute^Attribute_Name", "a") not in got
    assert {("g", "c", "Attribute_Attribute_Name", "a"), ("g", "a", "Name^Attribute^Attribute", "c")} <= set(got)


def test_api_scores():
    assert code.api_score("nn.relu", "tf.nn.relu") > code.api_score("nn.Relu", "tf.nn.relu") > 0 == code.api_score("tf.nn.relu6", "tf.nn.relu")


def test_graphdef(spark):
    text = '{"node":[{"name":"a/b","op":"Const","attr":{"dtype":{"type":"DT_FLOAT"},"shape":{"shape":{"dim":[{"size":"3"},{"size":"4"}]}},"T":{"type":"DT_INT"}}},{"name":"c","op":"Add","input":["a/b:0","^a/b"]}]}'
    rows = graphdef.triples(spark.createDataFrame([(1, text), (2, "no json"), (3, None)], "g int, t string"), "g", "t")
    got = {tuple(r)[1:] for r in rows.collect()}
    assert {("a/b", "shape", "3,4"), ("a/b", "T_type", "DT_INT"), ("a", "hasMember", "a/b"), ("a/b", "feeds", "c")} <= got
    edges = spark.createDataFrame([("a/b/x", "a/c/y"), ("a/b/x", "a/b/z"), ("q", "a/b")], "src string, dst string")
    kept = spark.createDataFrame([("a",), ("a/b",)], "name string")
    assert [tuple(r) for r in graphdef.simplified(edges, kept).collect()] == [("a/b", "a")]


def test_scopes_bindings_and_uses(spark):
    source = (
        "import os\nfrom m import helper as h, thing\n\nclass A:\n    def __init__(self): pass\n    def run(self): pass\n\nclass B(A):\n    def go(self):\n        return self.run()\n\n"
        "def f(os):\n    os.path()\n    return [h(x) for x in os]\n\ndef g():\n    a, b = h, thing\n    a()\n    b()\n    c: int = h\n    c()\n    for a in []:\n        a()\n    k = lambda h: h()\n    B()\n    os.getcwd\n"
    )
    df = spark.createDataFrame([("r", 1, "r/n.py", source)], "stored_dir_name string, file_id long, code_path string, code string")
    inner = {(r.kind, r.src, r.dst) for r in code.facts(df, inner=True).collect()}
    assert {("calls", "n.f.listcomp", "m.helper"), ("calls", "n.g.lambda", "h"), ("calls", "n.g", "m.helper"), ("calls", "n.g", "m.thing"), ("calls", "n.g", "a"), ("calls", "n.f", "os.path"), ("uses", "n.g", "os.getcwd")} <= inner
    found = code.facts(df)
    assert ("calls", "n.f", "m.helper") in {(r.kind, r.src, r.dst) for r in found.collect()}
    calls = found.filter("kind = 'calls'").select("repo", "src", "dst").distinct()
    assert {tuple(r)[1:] for r in code.constructor_edges(calls, found).collect()} == {("n.g", "n.A.__init__")}
    assert {(r.cls, r.base, r.place) for r in code.resolution_orders(found).collect()} == {("n.B", "n.A", 0)}
    known = {r.name: r.flavor for r in code.nodes(found).collect()}
    assert known["n.A"] == "class" and known["n.A.run"] == "method" and known["n.f"] == "function"
    e = spark.createDataFrame([("r", "x", "*.run"), ("r", "x", "n.A.run"), ("r", "x", "n.B.run"), ("r", "y", "*.run"), ("r", "z", "n.A.run")], "repo string, src string, dst string")
    assert {tuple(r)[1:] for r in code.culled(code.without_wildcards(e), found).collect()} == {("x", "n.B.run"), ("y", "*.run"), ("z", "n.A.run")}
