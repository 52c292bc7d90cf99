"""Syntax check of whole source files: ``first_error(extension, text)`` for py, js, java, json, ipynb and xml.

Each language has a lexer that turns a file into a string with one character per token and a grammar of the folder
``grammars``. The token streams are parsed to their end. Pieces that repeat (a logical line of Python, a statement
or a bracketed group of JavaScript and Java) are parsed once by the chart parser and their verdict is kept by token
shape, so that work follows the number of distinct shapes. Any piece that fails sends the file to a second parse of
its whole token stream, which gives the verdict and the place of the first token that no derivation can pass.
"""

from __future__ import annotations

import re
import sys
from functools import cache
from pathlib import Path

from knotwork.llm.syntax.chart import END, Grammar

#: Shapes kept per process; the oldest go first. A bound on memory, not on what is parsed.
KEPT = 200_000
#: Longest token string whose verdict is kept.
KEPT_LENGTH = 2_000
#: Character of a lexical error; no grammar has it.
BAD = "\x01"
#: Stands after a piece that is not the last of its group.
MORE = "\x02"

LANGUAGES = ("py", "ipynb", "json", "js", "java", "xml")


@cache
def grammar(name: str) -> Grammar:
    return Grammar((Path(__file__).parent / "grammars" / f"{name}.txt").read_text())


class Kept(dict):
    """A dictionary that computes what is missing and stays within ``KEPT`` entries."""

    def __init__(self, make, longest: int = KEPT_LENGTH) -> None:
        super().__init__()
        self.make = make
        self.longest = longest

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.longest and not (isinstance(key, tuple) and len(key[1]) > self.longest):
            if len(self) >= KEPT:
                del self[next(iter(self))]
            self[key] = value
        return value


def substitute(pattern: re.Pattern, replace, text: str) -> tuple[str, list[int]]:
    """As ``pattern.sub``, with the offset in ``text`` of each character of the result."""
    out, where, at = [], [], 0
    for m in pattern.finditer(text):
        out.append(text[at : m.start()])
        where.extend(range(at, m.start()))
        new = replace(m)
        out.append(new)
        where.extend([m.start()] * len(new))
        at = m.end()
    out.append(text[at:])
    where.extend(range(at, len(text) + 1))
    return "".join(out), where


def mapped(pattern: re.Pattern, words: dict, text: str) -> str:
    """As ``pattern.sub`` with the dictionary's value for each match; ``pattern`` is one group."""
    parts = pattern.split(text)
    parts[1::2] = map(words.__getitem__, parts[1::2])
    return "".join(parts)


def passes_where(passes: list, text: str) -> tuple[str, list[int]]:
    """Apply (pattern, replacement) passes in turn, carrying offsets in the first text along."""
    where = list(range(len(text) + 1))
    for pattern, replace in passes:
        text, inner = substitute(pattern, replace, text)
        where = [where[k] for k in inner]
    return text, where


def line_of(text: str, offset: int) -> int:
    return text.count("\n", 0, offset) + 1


# --- Python

_PY_TEXT = re.compile(
    r'''#[^\n]*|"""[^\\"]*(?:(?:\\[\s\S]|"(?!""))[^\\"]*)*"""|\'\'\'[^\\']*(?:(?:\\[\s\S]|'(?!''))[^\\']*)*\'\'\'|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|"|'|\\\n'''
)
_PY_PREFIX = re.compile(r"(?<![^\W])(?:[rRbBuUfF]|[rR][bBfF]|[bBfF][rR])\Z")
# words and digits, a word being taken with a text that follows at once (the text itself is one character by then)
_PY_WORD = re.compile(r"(\w+[\x04\x05]?)")
# the parts of a number; h is an exponent that lacks its sign, z has leading zeros
_NUMBER_PARTS = re.compile(r"[0z]\.(?:h[+-][0z]|[0z])?|\.(?:h[+-][0z]|[0z])|h[+-][0z]")
_PY_RUN = re.compile(r"[=!<>+\-*/%@&|^:.]{2,}|[`$?!]")
_PY_OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|\*\*|//|>>|<<|[<>=!:+\-*/%@&|^]=|->|[\s\S]")
_PY_NUMBER = re.compile(r"0[xX](?:_?[\da-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:0(?:_?0)*|[1-9](?:_?\d)*)|\d(?:_?\d)*(?:[eE]\d(?:_?\d)*[jJ]?|[jJ])")
_PY_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*(?:\\x(?![\da-fA-F]{2})|\\u(?![\da-fA-F]{4})|\\U(?!(?:000|0010)[\da-fA-F]{4,5})|\\N(?!\{[^}]+\}))")
_PY_BAD_BYTES = re.compile(r"(?<!\\)(?:\\\\)*\\x(?![\da-fA-F]{2})")
_PY_HEADS = {
    "if": ("if_h", "I"), "elif": ("elif_h", "L"), "else": ("else_h", "E"), "for": ("for_h", "F"), "while": ("while_h", "W"), "try": ("try_h", "T"),
    "except": ("except_h", "X"), "finally": ("finally_h", "Y"), "with": ("with_h", "w"), "def": ("def_h", "D"), "class": ("class_h", "D"), "match": ("match_h", "M"), "case": ("case_h", "K"),
}


def _fields(body: str, raw: bool, depth: int = 0) -> list[str] | None:
    """The expressions in the braces of a formatted string; None if its braces are unsound."""
    out, at, n = [], 0, len(body)
    while at < n:
        c = body[at]
        if c == "{":
            if not depth and body[at : at + 2] == "{{":
                at += 2
                continue
            level, k, quote = 0, at + 1, ""
            while k < n:
                d = body[k]
                if quote:
                    if body.startswith(quote, k):
                        k += len(quote) - 1
                        quote = ""
                    elif d == "\\":
                        k += 1
                elif d in "\"'":
                    quote = d * 3 if body[k : k + 3] == d * 3 else d
                    k += len(quote) - 1
                elif d in "([{":
                    level += 1
                elif d in ")]":
                    level -= 1
                elif d == "}":
                    if level == 0:
                        break
                    level -= 1
                elif level == 0 and (d == ":" or (d == "!" and body[k + 1 : k + 2] != "=")):
                    break
                k += 1
            if k >= n:
                return None
            out.append(body[at + 1 : k])
            if body[k] == "!":
                if not re.match(r"![sra]\s*[:}]", body[k : k + 9]):
                    return None
                k = body.index("}" if ":" not in body[k:] or body.find("}", k) < body.find(":", k) else ":", k)
            if body[k] == ":":
                level, e = 0, k + 1
                while e < n and not (body[e] == "}" and level == 0):
                    level += {"{": 1, "}": -1}.get(body[e], 0)
                    e += 1
                if e >= n:
                    return None
                inner = _fields(body[k + 1 : e], raw, depth + 1)
                if inner is None:
                    return None
                out += inner
                k = e
            at = k + 1
        elif c == "}":
            if depth or body[at : at + 2] != "}}":
                return None
            at += 2
        elif c == "\\" and not raw:
            at += 2
            if body[at - 1 : at] == "N" and body[at : at + 1] == "{":
                at = body.find("}", at) + 1 or n
        else:
            at += 1
    return out


class Python:
    """Lexer, line shapes and block structure of Python 3."""

    def __init__(self) -> None:
        self.g = grammar("python")
        self.code = self.g.code
        self.token = Kept(self._token, 60)
        self.run = Kept(self._run, 60)
        self.line = Kept(self._line)
        self.row = Kept(self._row)
        self.head = {self.code[w]: h for w, h in _PY_HEADS.items()}

    def _token(self, s: str) -> str:
        c = s[0]
        if s in self.code:
            return self.code[s]
        if s[-1] in "\x04\x05":
            if _PY_PREFIX.match(s[:-1]):
                return "b" if "b" in s.lower() else "s"
            return self.code.get(s[:-1], "a") + "s"
        if c.isdigit():
            if s.isdigit() and s.isascii():
                return "0" if c != "0" or not s.strip("0") else "z"
            if _PY_NUMBER.fullmatch(s) or (s[-1] in "jJ" and s[:-1].isdigit()):
                return "0"
            if s[-1] in "eE" and re.fullmatch(r"\d+(?:_\d+)*", s[:-1]):
                return "h"
            m = re.match(r"(0[xX][\da-fA-F_]+?|\d+)(and|else|for|if|in|is|or|not)\Z", s)
            return "0" + self.code[m[2]] if m else BAD
        return "a" if s.isidentifier() else BAD

    def _run(self, s: str) -> str:
        return "".join(BAD if x in ("`", "$", "?", "!") else self.code.get(x, x) for x in _PY_OP.findall(s))

    def _text(self, m: re.Match) -> str:
        s = m[0]
        if s[0] == "#":
            return ""
        if s[0] == "\\":
            return " \r"
        if len(s) == 1:
            return BAD
        before = m.string[max(0, m.start() - 3) : m.start()]
        prefix = ""
        if before and before[-1] in "rRbBuUfF":
            for k in (2, 1):
                if len(before) >= k and _PY_PREFIX.match(before[-k:]) and not (before[-k - 1 : -k].isalnum() or before[-k - 1 : -k] == "_"):
                    prefix = before[-k:].lower()
                    break
        if len(s) < 40 and not prefix and "\\" not in s:
            return "\x04" + ("\r" * s.count("\n") if "\n" in s else "")
        kind = self._string(prefix, s)
        return kind.replace("b", "\x05").replace("s", "\x04") if kind != BAD else BAD

    def _string(self, prefix: str, s: str) -> str:
        n = 3 if s[:3] in ('"""', "'''") and len(s) >= 6 else 1
        body = s[n:-n]
        kind = "b" if "b" in prefix else "s"
        if kind == "b":
            if not body.isascii() or ("r" not in prefix and _PY_BAD_BYTES.search(body)):
                return BAD
        elif "r" not in prefix and "\\" in body and _PY_BAD_ESCAPE.search(body):
            return BAD
        if "f" in prefix and ("{" in body or "}" in body):
            parts = _fields(body, "r" in prefix)
            if parts is None:
                return BAD
            for p in parts:
                if not (p.isidentifier() and p not in self.code or self.expression(p)):
                    return BAD
        return kind + "\r" * s.count("\n")

    def lex(self, text: str) -> str:
        t = mapped(_PY_WORD, self.token, _PY_TEXT.sub(self._text, text))
        t = _NUMBER_PARTS.sub("0", t).replace("z", BAD)
        run = self.run
        return _PY_RUN.sub(lambda m: run[m[0]], t).replace("\x04", "s").replace("\x05", "b")

    def expression(self, text: str) -> bool:
        shape = re.sub(r"\s+", "", self.lex(text))
        return bool(shape) and self.line["\x03" + shape] is not None

    def _row(self, row: str):
        """Open brackets of a row, and what its shape is if there are none."""
        shape = "".join(row.split())
        depth = sum(map(shape.count, "([{")) - sum(map(shape.count, ")]}"))
        return depth, self.line[shape] if depth <= 0 and shape else None

    def _line(self, shape: str):
        """(kind, whether a block must follow) of a logical line; None if it is no line of the grammar."""
        g = self.g
        if shape[0] == "\x03":
            return ("s", False) if g.accepts("fstringexpr", shape[1:]) else None
        first = shape[0]
        if first == self.code["async"] and len(shape) > 1:
            first = shape[1]
        if first in self.head:
            rule, kind = self.head[first]
            g.load(shape)
            ends = g.ends(rule)
            if len(shape) in ends:
                return kind, True
            for e in ends:
                if len(shape) in g.ends("simple", e):
                    return kind, False
            if first not in (self.code["match"], self.code["case"]):
                return None
        if first == "@":
            return ("d", False) if g.accepts("decorator", shape) else None
        return ("s", False) if g.accepts("simple", shape) else None

    def first_error(self, text: str) -> tuple[int, str] | None:
        if text[:1] == "\ufeff":
            text = text[1:]
        if "\0" in text:
            return line_of(text, text.index("\0")), "null byte"
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        rows = self.lex(text).split("\n")
        at = 0
        depth = 0
        shape = ""
        stack = [("", (0, 0))]  # what the last statement of the block leaves open, and its column by two tab widths
        wait = ""  # kind of the line whose block must come
        start = 1
        known = self.row
        for raw in rows:
            at += 1
            if depth == 0:
                shape = raw.lstrip(" \t\f")
                if not shape or shape.isspace():
                    at += raw.count("\r")
                    continue
                indent = raw[: len(raw) - len(shape)]
                start = at
            else:
                shape += raw
            if "\r" in raw:
                at += raw.count("\r")
            depth, info = known[shape]
            if depth > 0:
                continue
            depth = 0
            if info is None:
                return start, "invalid syntax"
            kind, block = info
            if "\t" in indent or "\f" in indent:
                indent = indent.replace("\f", "")
                col = (len(indent.expandtabs(8)), len(indent))
            else:
                col = (len(indent), len(indent))
            top = stack[-1][1]
            if wait:
                if not (col[0] > top[0] and col[1] > top[1]):
                    return start, "inconsistent tabs" if col[0] > top[0] else "expected an indented block"
                stack.append(("K" if wait == "M" else "", col))
                wait = ""
            else:
                while col[0] < stack[-1][1][0]:
                    if stack[-1][0] in ("T", "d"):
                        return start, "open try or decorator"
                    stack.pop()
                top = stack[-1][1]
                if col != top:
                    return start, "inconsistent tabs" if col[0] == top[0] else ("unexpected indent" if col[0] > top[0] else "unindent matches no block")
            last = stack[-1][0]
            if (last == "K" or kind == "K") and not (last == "K" and kind == "K"):
                return start, "case outside match" if kind == "K" else "no case in match"
            if last == "T" and kind not in "XY":
                return start, "expected except or finally"
            if last == "d" and kind not in "Dd":
                return start, "decorator without definition"
            if kind == "L":
                ok, new = last in ("I",), "I"
            elif kind == "E":
                ok, new = last in ("I", "F", "W", "X"), "e" if last == "X" else ""
            elif kind == "X":
                ok, new = last in ("T", "X"), "X"
            elif kind == "Y":
                ok, new = last in ("T", "X", "e"), ""
            else:
                ok, new = True, kind if kind in "IFWTdK" else ""
            if not ok:
                return start, "clause without its statement"
            stack[-1] = (new, stack[-1][1])
            if block:
                wait = kind
        if depth > 0:
            return start, "bracket never closed"
        if wait:
            return at, "expected an indented block"
        if any(s[0] in ("T", "d") for s in stack):
            return at, "open try or decorator"
        return None


# --- JavaScript and Java

_JS_TEXT = re.compile(
    r"""//[^\n]*|/\*[\s\S]*?\*/|<!--[^\n]*|"[^"\\\n]*(?:\\[\s\S][^"\\\n]*)*"|'[^'\\\n]*(?:\\[\s\S][^'\\\n]*)*'|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`[^`]*`|\{[^{}`]*\})*\})*`"""
    r"""|/(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*|"|'|`"""
)
# before a pattern literal stands an operator, an opening bracket or one of these words; otherwise / divides
_JS_DIVIDES = re.compile(r"(?:[\w$)\]}\x04\x05]|\+\+|--)\s*\Z")
_JS_PATTERN = re.compile(r"(?<![\w$.])(?:return|typeof|case|in|of|delete|void|throw|else|do)\s*\Z")
_JS_WORD = re.compile(r"([\w$]+)")
_JS_RUN = re.compile(r"[=!<>+\-*/%&|^?.]{2,}|[\\@“”‘’«»…—–\x00]")
_JS_OP = re.compile(r">>>=|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|===|!==|\.\.\.|>>>|=>|==|!=|<=|>=|\*\*|\+\+|--|<<|>>|&&|\|\||\?\?|\?\.|[+\-*/%&|^]=|[\s\S]")
_JS_BLANK = re.compile(r"[ \t\r\f\v\xa0\ufeff]+")
_JS_NUMBER = re.compile(r"0[xX](?:_?[\da-fA-F])+n?|0[bB](?:_?[01])+n?|0[oO](?:_?[0-7])+n?|\d(?:_?\d)*(?:n|[eE]\d+)?")
_JAVA_TEXT = re.compile(
    r'''//[^\n]*|/\*[\s\S]*?\*/|"""[ \t\f]*\r?\n[^\\"]*(?:(?:\\[\s\S]|"(?!""))[^\\"]*)*"""|"[^"\\\n]*(?:\\[^\n][^"\\\n]*)*"|'(?:[^'\\\n]|\\[^\n])+\'|"|\''''
)
_JAVA_WORD = _JS_WORD
_JAVA_RUN = re.compile(r"[=!<>+\-*/%&|^:.]{2,}|[\\#`\x00“”‘’«»…—–]")
_JAVA_OP = re.compile(r">>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|[\s\S]")
_JAVA_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|\d[\d_]*)[lL]?|\d[\d_]*(?:[eE]\d[\d_]*)?[fFdD]?|0[xX][\da-fA-F_]+[pP]\d+[fFdD]?")
_JAVA_ESCAPE = re.compile(r"\\(?!u+[\da-fA-F]{4}|[btnfrs\"'\\0-7\r\n])")
_PRIMITIVE = frozenset("boolean byte char short int long float double".split())
_SEGMENT = re.compile(r"[^;{}]*[;{}]|[^;{}]+")
_PAREN = re.compile(r"\([^()]*\)")


class Braces:
    """Reduction of a token stream by its bracketed groups, from the inside out."""

    def __init__(self, name: str) -> None:
        self.g = grammar(name)
        self.code = self.g.code
        self.token = Kept(self._token, 60)
        self.run = Kept(self._run, 60)
        self.balance = Kept(lambda s: s.count("(") - s.count(")") + s.count("[") - s.count("]"))
        self.piece = Kept(lambda k: self.g.accepts(k[0], k[1], END if k[2] else MORE))
        self.role = Kept(self._role)
        self.opens = Kept(self._opens)
        c = self.code
        self.loops = {c[w] for w in ("for", "while", "do")}
        self.control = self.loops | {c[w] for w in ("if", "with", "switch", "catch", "synchronized") if w in c}

    def reduced(self, stream: str) -> str | None:
        """What is wrong with the stream, as far as pieces tell; None if every piece is sound."""
        segs = _SEGMENT.findall(stream)
        cur, ok, raw = "", True, []
        kind, fn, loop, sw = self.top, self.free, False, False
        stack = []
        count = len(segs)
        for k, seg in enumerate(segs):
            c = seg[-1]
            if c == ";":
                cur += seg
                if self.balance[cur] > 0:
                    continue
            elif c == "{":
                cur += seg[:-1]
                new, is_fn, is_loop, is_switch = self.opens[cur]
                stack.append((cur, ok, raw, kind, fn, loop, sw))
                kind = new
                if is_fn:
                    fn, loop, sw = True, False, False
                else:
                    loop, sw = loop or is_loop, sw or is_switch
                cur, ok, raw = "", True, []
                continue
            elif c == "}":
                cur += seg[:-1]
                if not stack:
                    return "unexpected }"
                if cur:
                    if not self._jumps(cur, fn, loop, sw):
                        return "jump outside its statement"
                    if kind in self.lists:
                        ok = ok and self.piece[self.lists[kind], cur, True]
                    raw.append(cur)
                role = self.role[kind, "".join(raw)] if kind not in self.lists else ("E" if not raw else kind if ok else BAD)
                if role == BAD:
                    return "invalid group"
                cur, ok, raw, kind, fn, loop, sw = stack.pop()
                cur += role
                if k + 1 < count and (segs[k + 1][0] in self.goes_on or self.balance[cur] > 0 or segs[k + 1] == "}"):
                    continue
                if self.balance[cur] > 0:
                    continue
            else:
                cur += seg
                continue
            if not self._jumps(cur, fn, loop, sw):
                return "jump outside its statement"
            if kind in self.lists:
                ok = ok and self.piece[self.lists[kind], cur, False]
                raw.append("S")
            else:
                raw.append(cur)
            cur = ""
        if stack:
            return "group never closed"
        if cur and not self._jumps(cur, fn, loop, sw):
            return "jump outside its statement"
        if self.top in self.lists:
            return None if ok and (not cur or self.piece[self.lists[self.top], cur, True]) else "invalid statement"
        return None if self.piece[self.whole, "".join(raw) + cur, True] else "invalid unit"

    def _jumps(self, piece: str, fn: bool, loop: bool, sw: bool) -> bool:
        c = self.code
        if not fn and c["return"] in piece:
            return False
        if not (loop or sw) and c["break"] in piece and c["break"] + "a" not in piece:
            return False
        return loop or c["continue"] not in piece or c["continue"] + "a" in piece

    def first_error(self, text: str) -> tuple[int, str] | None:
        stream = self.lex(text)
        why = self.reduced(stream)
        if why is None:
            return None
        stream, where = self.lex_where(text)
        fine = self.g.accepts(self.whole, stream)
        if fine and why != "jump outside its statement":
            return None
        at = min(self.g.far, len(stream)) if not fine else 0
        return line_of(text, where[at] if at < len(where) else len(text)), "invalid syntax" if not fine else why


class JavaScript(Braces):
    top, whole, free = "B", "script", False
    lists = {"B": "stmts", "C": "members"}

    def __init__(self) -> None:
        super().__init__("javascript")
        c = self.code
        words = [x for w, x in c.items() if w.isalpha()]
        binary = {c[w] for w in ("in", "instanceof")}
        closing = "".join(c[w] for w in ("this", "null", "true", "false", "super", "break", "continue", "return", "let", "static", "async", "await", "yield", "of", "get", "set", "++", "--", "debugger"))
        opening = "".join(x for x in words if x not in binary | {c[w] for w in ("extends", "of")})
        self._end = re.compile(rf"(?<=[a0st)\]}}{closing}])\n+(?=[a0st{{!~#{opening}{c['++']}{c['--']}])")
        # what may follow a group without beginning a new statement
        self.goes_on = set(";,.)](?:=+-*/%<>&|^[t") | {c[w] for w in c if not w.isalpha() and w not in ("++", "--", "...")} | binary | {c[w] for w in ("else", "catch", "finally", "while", "of")} | {"N"}
        self._block_after = {c[w] for w in ("else", "try", "do", "finally", "=>")}

    def _token(self, s: str) -> str:
        if s in self.code:
            return self.code[s]
        if s[0].isdigit():
            return "0" if s.isdigit() or _JS_NUMBER.fullmatch(s) else "h" if s[-1] in "eE" and s[:-1].isdigit() else BAD
        return "a"

    def _run(self, s: str) -> str:
        return "".join(BAD if x in "\\@“”‘’«»…—–\0" else self.code.get(x, x) for x in _JS_OP.findall(s))

    def _text(self, m: re.Match) -> str:
        s = m[0]
        c = s[0]
        if c == "/":
            if s[1] == "*":
                return "\n" if "\n" in s else " "
            if s[1] == "/":
                return ""
            before = m.string[max(0, m.start() - 40) : m.start()]
            if _JS_DIVIDES.search(before) and not _JS_PATTERN.search(before):
                return "/" + _JS_TEXT.sub(self._text, s[1:])
            return "\x04"
        if len(s) == 1:
            return BAD
        if c == "<":
            return ""
        if c == "`":
            return "\x05" if "${" not in s or self._template(s[1:-1]) else BAD
        return "\x04"

    def _template(self, body: str) -> bool:
        for m in re.finditer(r"(?<!\\)\$\{((?:[^{}]|\{[^{}]*\})*)\}", body):
            if not self.g.accepts("exprs", self.lex(m[1])):
                return False
        return True

    def _ends(self, stream: str) -> str:
        return self._end.sub("N", stream).replace("\n", "")

    def lex(self, text: str) -> str:
        if text[:2] == "#!":
            text = "//" + text
        t = mapped(_JS_WORD, self.token, _JS_TEXT.sub(self._text, text))
        run = self.run
        t = _JS_RUN.sub(lambda m: run[m[0]], _NUMBER_PARTS.sub("0", t))
        return self._ends(_JS_BLANK.sub("", t).replace("\x04", "s").replace("\x05", "t"))

    def lex_where(self, text: str) -> tuple[str, list[int]]:
        stream, where = passes_where(
            [(_JS_TEXT, self._text), (_JS_WORD, lambda m: self.token[m[0]]), (_NUMBER_PARTS, lambda m: "0"), (_JS_RUN, lambda m: self.run[m[0]]), (_JS_BLANK, lambda m: "")], text
        )
        marked = self._end.sub(lambda m: "N" + "\n" * (len(m[0]) - 1), stream.replace("\x04", "s").replace("\x05", "t"))
        keep = [k for k, c in enumerate(marked) if c != "\n"]
        return "".join(marked[k] for k in keep), [where[k] for k in keep] + [len(text)]

    def _opens(self, cur: str) -> tuple[str, bool, bool, bool]:
        """Kind of the group that begins after ``cur``, and whether it is of a function, a loop, a switch."""
        c = self.code
        head = cur.rstrip("N")
        last = head[-1:] or "{"
        flat = head
        while (new := _PAREN.sub("p", flat)) != flat:
            flat = new
        if last == ")":
            before = flat[-2:-1]
            is_fn = before not in self.control
            if before == c["switch"]:
                return "W", False, False, True
            return "B", is_fn, before in self.loops, False
        if last in self._block_after:
            return "B", last == c["=>"], last == c["do"], False
        if c["class"] in flat and flat.rfind(c["class"]) > max(flat.rfind(x) for x in ",=(["):
            return "C", True, False, False
        return "?", False, False, False

    def _role(self, key: tuple[str, str]) -> str:
        kind, content = key
        accepts = self.g.accepts
        if not content.strip("N"):
            return "E"
        if kind == "W":
            return "W" if accepts("cases", content) else BAD
        roles = accepts("stmts", content), accepts("inobject", content.strip("N")), False
        return {(True, True): "D", (True, False): "B", (False, True): "O"}.get(roles[:2], BAD)


class Java(Braces):
    top, whole, free = "unit", "unit", True
    lists = {"B": "stmts", "C": "members"}

    def __init__(self) -> None:
        super().__init__("java")
        c = self.code
        self.goes_on = set(";,.)](?:=+-*/%<>&|^[") | {c[w] for w in ("else", "catch", "finally", "while", "==", "!=", "&&", "||", "instanceof")}
        self._block_after = {c[w] for w in ("else", "try", "do", "finally", "->", "static")}
        self._types = "".join(c[w] for w in ("class", "interface", "record"))
        self._type = re.compile(rf"[{c['class']}{c['interface']}]a|{c['record']}a[p<]")
        self._new = re.compile(rf"{c['new']}[^;=+\-]*p\Z")

    def _token(self, s: str) -> str:
        if s in self.code:
            return self.code[s]
        if s in _PRIMITIVE:
            return "P"
        if s[0].isdigit():
            return "0" if _JAVA_NUMBER.fullmatch(s) else "h" if s[-1] in "eE" and s[:-1].isdigit() else BAD
        return "a" if s != "_" else BAD

    def _run(self, s: str) -> str:
        return "".join(BAD if x in "\\#`\0“”‘’«»…—–" else self.code.get(x, x) for x in _JAVA_OP.findall(s))

    def _text(self, m: re.Match) -> str:
        s = m[0]
        if s[0] == "/":
            return " "
        if len(s) == 1 or s == '""' and m.string[m.end() : m.end() + 1] == '"':
            return BAD
        if "\\" in s and _JAVA_ESCAPE.search(s.replace("\\\\", "")):
            return BAD
        if s[0] == "'" and not re.fullmatch(r"'(?:\\(?:u+[\da-fA-F]{4}|[0-3]?[0-7]{1,2}|.)|[^\\]|[\ud800-\U0010ffff])'", s):
            return BAD
        return "\x04"

    def lex(self, text: str) -> str:
        t = mapped(_JAVA_WORD, self.token, _JAVA_TEXT.sub(self._text, text))
        run = self.run
        return "".join(_JAVA_RUN.sub(lambda m: run[m[0]], _NUMBER_PARTS.sub("0", t)).split()).replace("\x04", "s")

    def lex_where(self, text: str) -> tuple[str, list[int]]:
        stream, where = passes_where(
            [(_JAVA_TEXT, self._text), (_JAVA_WORD, lambda m: self.token[m[0]]), (_NUMBER_PARTS, lambda m: "0"), (_JAVA_RUN, lambda m: self.run[m[0]]), (re.compile(r"\s+"), lambda m: "")], text
        )
        return stream.replace("\x04", "s"), where

    def _opens(self, cur: str) -> tuple[str, bool, bool, bool]:
        c = self.code
        flat = cur
        while (new := _PAREN.sub("p", flat)) != flat:
            flat = new
        if c["enum"] in flat:
            return "U", True, False, False
        if self._type.search(flat) or self._new.search(flat):
            return "C", True, False, False
        last = cur[-1:]
        if last == ")":
            before = flat[-2:-1]
            if before == c["switch"]:
                return "W", False, False, True
            return "B", before not in self.control, before in self.loops, False
        if c["throws"] in flat:
            return "B", True, False, False
        if last in self._block_after or not last or last == ":":
            return "B", last == c["->"], last == c["do"], False
        return "A", False, False, False

    def _role(self, key: tuple[str, str]) -> str:
        kind, content = key
        if not content:
            return "E"
        return kind if self.g.accepts({"W": "cases", "U": "enumin", "A": "inits"}[kind], content) else BAD


# --- JSON

_JSON = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|\b(?:true|false|null)\b|[ \t\n\r]+|[^\[\]{},:]')


class Json:
    """JSON by the chart parser over its whole token stream."""

    def __init__(self) -> None:
        self.g = grammar("json")
        self.token = Kept(lambda s: "" if s[0] in " \t\n\r" else "s" if s[0] == '"' and len(s) > 1 else "v" if s[0] in "-0123456789tfn" and s != "-" and (len(s) > 1 or s.isdigit()) else BAD, 40)

    def first_error(self, text: str) -> tuple[int, str] | None:
        if self.g.accepts("document", _JSON.sub(lambda m: self.token[m[0]], text)):
            return None
        stream, where = substitute(_JSON, lambda m: self.token[m[0]], text)
        self.g.accepts("document", stream)
        return line_of(text, where[min(self.g.far, len(where) - 1)]), "invalid JSON" if stream else "no value"


# --- XML

_XNAME = r"[A-Za-z_:\u00c0-\U000effff][\w:.\-\u00b7]*"
_XATTR = re.compile(rf"\s+({_XNAME})\s*=\s*(?:\"([^<\"]*)\"|'([^<']*)')")
_XML = re.compile(
    rf"(?P<x><\?xml\s[^?]*\?>)|(?P<p><!--(?:[^-]|-[^-])*-->|<\?(?![xX][mM][lL][\s?]){_XNAME}(?:\s[\s\S]*?)?\?>)|(?P<cd><!\[CDATA\[[\s\S]*?\]\]>)|(?P<d><!DOCTYPE\s+[^\[>]*(?:\[[^\]]*\]\s*)?>)"
    rf"|(?P<c></{_XNAME}\s*>)|(?P<o><{_XNAME}(?:\s+{_XNAME}\s*=\s*(?:\"[^<\"]*\"|'[^<']*'))*\s*/?>)|(?P<t>[^<]+)|(?P<bad><)"
)
_XREF = re.compile(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[\da-fA-F]+);)")
_XDECL = re.compile(r"""<\?xml\s+version\s*=\s*(?:"1\.\d+"|'1\.\d+')(?:\s+encoding\s*=\s*(?:"[A-Za-z][\w.\-]*"|'[A-Za-z][\w.\-]*'))?(?:\s+standalone\s*=\s*(?:"(?:yes|no)"|'(?:yes|no)'))?\s*\?>""")
_XCHAR = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


class Xml:
    """Well-formedness: lexing by markup, names on a stack, document structure by the grammar."""

    def __init__(self) -> None:
        self.g = grammar("xml")
        self.shape = Kept(lambda s: self.g.accepts("document", s))

    def first_error(self, text: str) -> tuple[int, str] | None:
        if text[:1] == "\ufeff":
            text = text[1:]
        bad = _XCHAR.search(text)
        if bad:
            return line_of(text, bad.start()), "invalid character"
        names: list[str] = []
        shape: list[str] = []
        entities = "<!ENTITY" in text
        for m in _XML.finditer(text):
            kind, s = m.lastgroup, m[0]
            why = ""
            if kind == "t":
                if _XREF.search(s) and not (entities and names):
                    why = "invalid reference"
                elif "]]>" in s:
                    why = "]]> in text"
                kind = "w" if not s.strip(" \t\r\n") else "t"
            elif kind == "cd":
                kind = "t"
            elif kind == "x":
                why = "" if m.start() == 0 and _XDECL.fullmatch(s) else "misplaced or invalid declaration"
            elif kind == "c":
                name = s[2:-1].rstrip()
                why = "" if names and names.pop() == name else "mismatched tag"
            elif kind == "o":
                attrs = _XATTR.findall(s)
                if len({a[0] for a in attrs}) < len(attrs):
                    why = "attribute given twice"
                elif not entities and any(_XREF.search(a[1] + a[2]) for a in attrs):
                    why = "invalid reference"
                if s[-2] == "/":
                    kind = "e"
                else:
                    names.append(re.match(_XNAME, s[1:])[0])
            elif kind == "bad":
                why = "invalid markup"
            if not why and not names and kind == "t":
                why = "text outside the root"
            if why:
                return line_of(text, m.start()), why
            shape.append(kind)
        if names or not self.shape["".join(shape)]:
            return line_of(text, len(text)), "element never closed" if names else "not one root element"
        return None


@cache
def parser(language: str):
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))
    return {"py": Python, "js": JavaScript, "java": Java, "json": Json, "ipynb": Json, "xml": Xml}[language]()


def first_error(language: str, text: str) -> tuple[int, str] | None:
    """Line (from 1) and message of the first unrecoverable error of a file; None if it parses to its end."""
    try:
        return parser(language).first_error(text)
    except RecursionError:
        # brackets nested deeper than usual: as many frames as the text can ask for
        before = sys.getrecursionlimit()
        sys.setrecursionlimit(max(before, 40 * len(text)))
        try:
            return parser(language).first_error(text)
        finally:
            sys.setrecursionlimit(before)
