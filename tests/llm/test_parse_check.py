import ast
import json
import random
import warnings
from pathlib import Path
from xml.parsers import expat

import pytest

from knotwork.llm import parse_check
from knotwork.llm.syntax import chart, files
from knotwork.llm.syntax.chart import Grammar
from knotwork.llm.syntax.files import first_error

PY_GOOD = [
    "", "\n", "# c", "x = 1", "def f(a, *, b=2, **k): return a", "async def f():\n    async with a as b, c:\n        await d\n    return [x async for x in y]", "if a:\n\tb\nelif c: d\nelse:\n\te", "try:\n    a\nexcept* E as e:\n    b\nfinally:\n    c",
    "f'{a!r:>{w}} {{x}} {d[\"k\"]}'", "x = (1,\n     2)\n", "match x:\n    case [1, *r] if r: pass\n    case {'a': 1, **k}: pass\n    case C(x=1) | None: pass", "match = 1\nmatch(x)\nprint(match)", "lambda *a, b=1, **k: (yield)", "a[1:2, ::3, ...] = b", "x: int = 3",
    "@d(1)\nclass A(B, metaclass=C):\n    '''doc'''\n    x = 1", "for i, *j in k: pass\nelse: pass", "while (n := f()) > 0: break", "print(*a, sep='', **k)", "type X[T] = list[T]", "def f[T: int](x: T) -> T: ...", "0x1F + 0b1 + 0o7 + 1_000 + 1.5e-3j + .5 + 5.", "a = b = c", "x = yield", "del a, b[0], (c)",
    "from . import (a, b as c,)\nimport x.y as z", "assert a, 'b'", "raise E from e", "global a, b", "a if b else c", "not a in b is not c", "'a' 'b' \\\n 'c'", "{**a, 'b': 1}", "{*a, 1}", "{x: y for x in z}", "with (open(a) as b, c): pass", "b'\\x00' b'c'", "class A: pass; x = 1", "x = 1 if y else 2,", "def f(a, /, b): pass",
]
PY_BAD = [
    "print 'a'", "def f(:", "if a\n    b", "x = (1", "x = 1)", "  x = 1", "if a:\nb", "try:\n    a", "else:\n    a", "x = '", "'''a", "f(a=1, b)", "f() = 1", "1x", "0777", "except A, B:\n    pass", "<<<<<<< HEAD", "def f((a, b)): pass", "class", "a b", "x = 5 +", "for x in: pass", "import", "return return",
    "def f(a=1, b): pass", "x = {1: 2, 3}", "\tif a:\n        b\n\tc\n  d", "f'{a b}'", "b'é'", "'\\x1'", "a := 1", "lambda x y: 1", "@d\nx = 1", "while True print(1)", "x = [1, 2", "async x", "$a", "a ? b : c", "case x:\n    pass\nmatch y:\n    pass", "del f()", "a += b += c", "with a as f(): pass", "\0",
]


def python_is_valid(code):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(code)
        return True
    except (SyntaxError, ValueError):
        return False


@pytest.mark.parametrize("code", PY_GOOD + PY_BAD)
def test_python_against_interpreter(code):
    assert (first_error("py", code) is None) == python_is_valid(code), code


def test_python_mutants_against_interpreter():
    r = random.Random(3)
    base = "\n".join(c for c in PY_GOOD if "\t" not in c)
    wrong = 0
    for _ in range(1500):
        code = r.choice([c for c in PY_GOOD if c] + [base])
        k = r.randrange(len(code))
        code = r.choice((code[:k], code[:k] + code[k + 1 :], code[:k] + r.choice("()[]{}:,'\"= \n.*0a") + code[k:]))
        wrong += (first_error("py", code) is None) != python_is_valid(code)
    # the grammar leaves some rules about assignment targets and formatted strings to the exact check
    assert wrong <= 15


JS_GOOD = ["", "'use strict'; var a = {b: [1,,2], c() {}, get d() { return 1 }, ...e}", "a\nb", "if (a) b\nelse c", "for (var i = 0; i < 3; i++) { continue }", "for (const x of y) z(x)", "var f = (a, b = 1) => ({c: a})", "function* g() { yield 1 }", "x = a / b / c; y = /re[/]x/gi.test(z)", "class A extends B { static x = 1; #p; constructor() { super(); } get y() { return 1 } }", "`a ${b + `c`} d`", "switch (a) { case 1: b; break; default: c }", "do x++; while (x < 3)", "label: for (;;) { break label }", "try { a } catch { b } finally { c }", "async () => { await x }", "(function(){ return 1 })()", "var {a, b: [c]} = d", "new A.B(c).d", "a ? b : c ? d : e", "return_ = 1 // c\n/* x\n */ b", "let x = a?.b ?? c", "throw new Error('x')", "if (a) { b } else if (c) { d }"]
JS_BAD = ["var a = ;", "function f( { }", "if (a {", "a b", "for (var i = 0; i < 3; i++ {", "{", "}", "return 1", "var x = 'a", "import a from 'b'", "<!DOCTYPE html>", "<<<<<<< HEAD\na", "# comment", "class { }", "x = {a: 1,, b: 2}", "break", "f(a", "function f() { return 1", "a => {", "let 1 = 2", "if a: b", "=======", "@@"]
JAVA_GOOD = ["", "package a.b; import java.util.*; public class A<T extends B & C> extends D implements E { private int x = 1, y[] = {1, 2}; static { x = 2; } public <U> U f(final List<? super T>... a) throws E, F { for (int i = 0; i < 3; i++) { x += i; } return (U) a; } }", "enum E { A, B(1) { void f() {} }; int x; E() {} }", "interface I { int f(); default void g() { } }", "record R(int a, String b) { R { } }", "class A { Runnable r = () -> { int x = a > b ? 1 : 2; }; int[] q = new int[3]; Object o = new Object() { int z = 1; public String toString() { return \"x\"; } }; }", "@interface X { String value() default \"\"; }", "class A { int f(Object o) { return switch (o) { case Integer i when i > 1 -> 1; default -> 0; }; } }", "class A { void f() { try (R r = x()) { a.<T>b()[0].c++; } catch (A | B e) { throw e; } finally { } l: while (true) { break l; } } }", 'class A { String s = """\n  text "q" """; char c = \'\\n\'; long l = 0xFFL; double d = 1e-3; }']
JAVA_BAD = ["class A {", "class A { int f( { } }", "class A { void f() { a; } }", "class A { void f() { int x = 1 } }", "import numpy as np", "x = 1;", "class A { public void f(int a, int b { } }", "class { }", "class A { String s = \"a; }", "<<<<<<< HEAD\nclass A { }", "class A { void f() { for (int i = 0; i < 3; i++ { } } }", "class A { } }"]
JSON_ANY = ["{}", "[]", "1", '"a"', "null", '{"a": [1, -2.5e3, {"b": "c\\u00e9\\n"}], "d": true}', "", "{", "[1,]", "{'a': 1}", '{"a" 1}', "01", "[1 2]", '{"a": 1}}', "nul", '"a\nb"', "// c\n{}", '{"a": 1,}', "NaN", "-", '["\\x"]', "\ufeff{}"]
XML_ANY = ["<a/>", "<?xml version='1.0'?>\n<a b='c'><d>e &amp; f</d><!-- g --><![CDATA[<x>]]></a>\n", "<!DOCTYPE a><a></a>", "", "text", "<a>", "<a></b>", "<a b=c/>", "<a b='1' b='2'/>", "<a>&b;</a>", "<a/><b/>", " <?xml version='1.0'?><a/>", "<a><b></a></b>", "<a b='<'/>", "<a>]]></a>", "<1a/>", "<a><!-- a -- b --></a>", "<a>\x01</a>"]


@pytest.mark.parametrize("language, good, bad", [("js", JS_GOOD, JS_BAD), ("java", JAVA_GOOD, JAVA_BAD)])
def test_brace_languages(language, good, bad):
    assert [c for c in good if first_error(language, c)] == []
    assert [c for c in bad if not first_error(language, c)] == []


def test_json_and_xml_against_parsers():
    def json_ok(t):
        try:
            json.loads(t, parse_constant=lambda c: 1 / 0)
            return True
        except (ValueError, ZeroDivisionError):
            return False

    def xml_ok(t):
        try:
            expat.ParserCreate().Parse(t.encode(), True)
            return True
        except expat.ExpatError:
            return False

    assert [t for t in JSON_ANY if (first_error("json", t) is None) != json_ok(t)] == []
    assert [t for t in XML_ANY if (first_error("xml", t) is None) != xml_ok(t)] == []


def test_error_lines():
    assert first_error("py", "a = 1\n\nb = (\n")[0] == 3
    assert first_error("js", "a();\nb(;\n")[0] == 2
    assert first_error("java", "class A {\n  int x = ;\n}")[0] == 2
    assert first_error("json", '{\n"a": 1,\n}')[0] == 3


def test_chart_is_exact_on_an_ambiguous_grammar():
    g = Grammar("s: a b | a 'y' ;\na: 'x'* ;\nb: 'x' 'x' ;")
    assert g.accepts("s", "xx") and g.accepts("s", "xxxxx") and g.accepts("s", "y") and not g.accepts("s", "x")


def test_long_and_deep_files():
    assert first_error("py", "x = [" + "1, " * 200_000 + "]") is None
    assert first_error("json", "[" * 3000 + "]" * 3000) is None
    assert first_error("js", "f(" * 300 + ")" * 300) is None


def test_table(spark):
    kind = "file_id long, stored_dir_name string, code_path string, code string, language string, error string"
    rows = [(1, "r", "a/b.PY", "x = (", "q", "q"), (2, "r", "a/c.py", "", None, None), (2, "r", "a/c.py", "", None, None), (3, "r", "d.json", "", None, None), (4, None, None, "x", None, None), (5, "r", "e.py", None, None, None), (6, "s", "f.txt", "x = (", None, None), (1, "r", "a/b.PY", "x = (", "q", "q")]
    df = spark.createDataFrame(rows, kind)
    assert sorted(r.file_id for r in parse_check.found(df).collect()) == [1, 3]
    rates = {(r.stored_dir_name, r.language): (r.files, r.broken, r.rate) for r in parse_check.rates(df).collect()}
    assert rates == {("r", "py"): (4, 2, 0.5), ("r", "json"): (1, 1, 1.0)}
    assert parse_check.found(df.limit(0)).count() == 0
    meta = spark.createDataFrame([("r", 'File "a/b.PY", line 1'), ("r", None), ("r", 'File "a/b.PY", line 1')], "dir_name string, err_msg string")
    told = {r.file_id: r.is_reported for r in parse_check.reported(df, meta).collect()}
    assert told == {1: True, 3: False}


def test_long_lists_are_parsed_to_their_end():
    lists = "1, -2, 'a', " * 300
    assert files.first_error("py", f"x = [{lists}3]\n") is None and files.first_error("js", f"x = [{lists}3];\n") is None
    for bad in ("1, 2 3, ", "1, -, 2, ", "1, -*2, "):
        assert files.first_error("py", f"x = [{lists}{bad}{lists}3]\n") is not None
        assert files.first_error("js", f"x = [{lists}{bad}{lists}3];\n") is not None
    rows = "{'a': [1, -2]}, " * 200
    assert files.first_error("py", f"x = [{rows}]\n") is None and files.first_error("py", f"x = [{rows}{{'a': [1 -]}}, {rows}]\n") is not None


def test_pair_tables_change_no_verdict():
    r = random.Random(8)
    for name, rule in (("python", "simple"), ("javascript", "script"), ("json", "document")):
        g = files.grammar(name)
        letters = [c for c in g._bit if c != chart.END]
        tables = g._pairs
        streams = ["".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(1500)] + ["a=[0,-0,0]", "a(0,a,s)", "[s,v]", "a=0;", "a.a(a)[0]"]
        fast = [g.accepts(rule, x) for x in streams]
        plain = chart.Grammar((Path(files.__file__).parent / "grammars" / f"{name}.txt").read_text())
        plain._pairs = {n: (0, 0, True, True, {}) for n in tables}
        plain._run = {n: plain._rule(n) for n in plain.rules}
        for n, node in plain.rules.items():
            plain._body[n] = plain._compile(node)
        assert fast == [plain.accepts(rule, x) for x in streams]
