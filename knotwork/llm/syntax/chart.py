"""A chart recogniser for context-free grammars, driven by prediction tables.

A grammar is text: ``%keywords`` and ``%operators`` lines declare terminals of several characters, then rules
``name: alternatives ;`` in EBNF (``?``, ``*``, ``+``, ``|``, brackets; ``&'x'`` looks ahead at x, ``&'END'`` at the end, ``!'x'`` at anything else). A token stream is a string with one
character per token. For every rule the FIRST set is computed and turned into a table from the next token to the
alternatives that can begin with it. A second table holds the pairs of tokens that can begin a rule, and the tokens that
are a rule on their own: where the next two tokens are no such pair, the rule can only be one token long, which settles
most items of long lists without a derivation. The chart holds, for each (rule, position), all positions where the rule can
end, so ambiguous and non-LL grammars are recognised exactly; only left recursion is excluded.
"""

from __future__ import annotations

import re

#: End of the token stream.
END = "\0"
#: First character used for terminals of more than one character.
PRIVATE = 0xE000

_TOKEN = re.compile(r"\s+|#[^\n]*|(?P<lit>'[^']+')|(?P<name>\w+)|(?P<op>[|*+?();:&!])")


class Grammar:
    """Compiled grammar: ``ends(rule, stream, at)`` gives the chart entry of a rule at a position."""

    def __init__(self, text: str) -> None:
        lines = text.split("\n")
        self.code: dict[str, str] = {}
        self.keywords: set[str] = set()
        for line in lines:
            if line.startswith(("%keywords", "%operators")):
                words = line.split()
                for w in words[1:]:
                    self.code.setdefault(w, chr(PRIVATE + len(self.code)))
                if words[0] == "%keywords":
                    self.keywords.update(words[1:])
        self._tokens = [m for m in _TOKEN.finditer("\n".join(x for x in lines if not x.startswith("%"))) if m.lastgroup]
        self._at = 0
        self.rules: dict[str, tuple] = {}
        while self._at < len(self._tokens):
            name = self._take("name")
            self._take("op", ":")
            self.rules[name] = self._alternatives()
            self._take("op", ";")
        self._nullable: set[str] = set()
        self._first: dict[str, set[str]] = {n: set() for n in self.rules}
        self._fixpoint()
        self._pair_tables()
        self.stream = END
        self.far = 0
        self._chart: dict[str, dict[int, tuple[int, ...]]] = {n: {} for n in self.rules}
        self._run = {n: self._rule(n) for n in self.rules}
        for n, node in self.rules.items():
            self._body[n] = self._compile(node)

    # --- reading the grammar text

    def _peek(self) -> str:
        return self._tokens[self._at][0] if self._at < len(self._tokens) else ""

    def _take(self, kind: str, value: str | None = None) -> str:
        m = self._tokens[self._at]
        if m.lastgroup != kind or (value and m[0] != value):
            raise ValueError(f"grammar: expected {value or kind}, found {m[0]!r} at {m.start()}")
        self._at += 1
        return m[0]

    def _alternatives(self) -> tuple:
        alts = [self._sequence()]
        while self._peek() == "|":
            self._at += 1
            alts.append(self._sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def _sequence(self) -> tuple:
        parts = []
        while self._peek() not in ("|", ";", ")", ""):
            m = self._tokens[self._at]
            if m[0] == "(":
                self._at += 1
                node = self._alternatives()
                self._take("op", ")")
            elif m[0] in "&!":
                self._at += 1
                word = self._take("lit")[1:-1]
                node = ("look" if m[0] == "&" else "not", END if word == "END" else self.code.get(word, word))
            elif m.lastgroup == "lit":
                self._at += 1
                word = m[0][1:-1]
                node = ("term", self.code[word] if word in self.code else word)
                if len(node[1]) != 1:
                    raise ValueError(f"grammar: {word!r} is no terminal")
            else:
                node = ("rule", self._take("name"))
            while self._peek() in ("*", "+", "?") and self._peek():
                node = (self._peek(), node)
                self._at += 1
            parts.append(node)
        return parts[0] if len(parts) == 1 else ("seq", parts)

    # --- tables

    def _first_of(self, node: tuple) -> tuple[set[str], bool]:
        kind, x = node
        if kind in ("term", "look"):
            return {x}, False
        if kind == "not":
            return set(), True
        if kind == "rule":
            return self._first[x], x in self._nullable
        if kind == "seq":
            out: set[str] = set()
            for part in x:
                first, empty = self._first_of(part)
                out |= first
                if not empty:
                    return out, False
            return out, True
        if kind == "alt":
            both = [self._first_of(a) for a in x]
            return set().union(*(f for f, _ in both)), any(e for _, e in both)
        first, empty = self._first_of(x)
        return first, empty or kind in "*?"

    def _fixpoint(self) -> None:
        changed = True
        while changed:
            changed = False
            for n, node in self.rules.items():
                first, empty = self._first_of(node)
                if empty and n not in self._nullable:
                    self._nullable.add(n)
                    changed = True
                if not first <= self._first[n]:
                    self._first[n] |= first
                    changed = True

    def _pair_tables(self) -> None:
        """For each rule: first tokens with the set of second ones as bits, and the tokens that are the rule on their own.

        A look-ahead counts as empty here, so pairs and single tokens are never too few; the sure single tokens are
        those of derivations without one.
        """
        letters = sorted(set().union(*self._first.values()) | {END})
        self._bit = {c: 1 << k for k, c in enumerate(letters)}
        # rule -> (mask of single tokens, mask of sure ones, can be empty, surely so, first token -> mask of second ones)
        table = {n: (0, 0, False, False, {}) for n in self.rules}

        def mask(first: dict) -> int:
            out = 0
            for c in first:
                out |= self._bit.setdefault(c, 1 << len(self._bit))
            return out

        def join(a: tuple, b: tuple) -> tuple:
            single, sure = (b[0] if a[2] else 0) | (a[0] if b[2] else 0), (b[1] if a[3] else 0) | (a[1] if b[3] else 0)
            first = {c: m | (mask(b[4]) if self._bit[c] & a[0] else 0) for c, m in a[4].items()}
            if a[2]:
                for c, m in b[4].items():
                    first[c] = first.get(c, 0) | m
            return single, sure, a[2] and b[2], a[3] and b[3], first

        def either(parts: list) -> tuple:
            first: dict = {}
            single = sure = 0
            for p in parts:
                single, sure = single | p[0], sure | p[1]
                for c, m in p[4].items():
                    first[c] = first.get(c, 0) | m
            return single, sure, any(p[2] for p in parts), any(p[3] for p in parts), first

        def of(node: tuple) -> tuple:
            kind, x = node
            if kind == "rule":
                return table[x]
            if kind == "term":
                b = self._bit.setdefault(x, 1 << len(self._bit))
                return b, b, False, False, {x: 0}
            if kind in ("look", "not"):
                return 0, 0, True, False, {}
            if kind == "seq":
                out = (0, 0, True, True, {})
                for part in x:
                    out = join(out, of(part))
                return out
            if kind == "alt":
                return either([of(a) for a in x])
            one = of(x)
            if kind == "?":
                return one[0], one[1], True, True, one[4]
            twice = join(one, one)
            return one[0], one[1], one[2] or kind == "*", one[3] or kind == "*", {c: m | twice[4].get(c, 0) for c, m in one[4].items()}

        changed = True
        while changed:
            changed = False
            for n, node in self.rules.items():
                new = of(node)
                if new != table[n]:
                    table[n] = new
                    changed = True
        self._pairs = table

    # --- recognition

    _body: dict

    def _rule(self, name: str):
        chart = self._chart[name]
        if "_body" not in self.__dict__:
            self._body = {}
        body = self._body
        single, sure, empty, _, pairs = self._pairs[name]
        bit = self._bit

        def run(at: int) -> tuple[int, ...]:
            ends = chart.get(at)
            if ends is None:
                stream = self.stream
                c = stream[at]
                if not empty and c in pairs and at + 1 < len(stream) and not pairs[c] & bit.get(stream[at + 1], 0):
                    alone = bit[c]
                    if not alone & single:
                        if at >= self.far:
                            self.far = at + 1
                        return ()
                    if alone & sure:
                        if at >= self.far:
                            self.far = at + 1
                        return (at + 1,)
                ends = chart[at] = body[name](at)
            return ends

        return run

    def _compile(self, node: tuple):
        kind, x = node
        if kind == "rule":
            return self._run[x]
        if kind == "term":

            def term(at: int) -> tuple[int, ...]:
                if self.stream[at] == x:
                    return (at + 1,)
                if at > self.far:
                    self.far = at
                return ()

            return term
        if kind == "look":
            return lambda at: (at,) if self.stream[at] == x else ()
        if kind == "not":
            return lambda at: (at,) if self.stream[at] != x else ()
        if kind == "seq":
            parts = [self._compile(p) for p in x]

            def seq(at: int) -> tuple[int, ...]:
                ends: tuple[int, ...] = (at,)
                for part in parts:
                    if len(ends) == 1:
                        ends = part(ends[0])
                    else:
                        ends = tuple({e for b in ends for e in part(b)})
                    if not ends:
                        return ()
                return ends

            return seq
        if kind == "alt":
            table: dict[str, list] = {}
            rest = []
            for a in x:
                first, empty = self._first_of(a)
                run = self._compile(a)
                if empty:
                    rest.append(run)
                for c in first:
                    table.setdefault(c, []).append(run)
            for c in table:
                table[c] = [*table[c], *(r for r in rest if r not in table[c])]

            def alt(at: int) -> tuple[int, ...]:
                runs = table.get(self.stream[at], rest)
                if len(runs) == 1:
                    return runs[0](at)
                if not runs:
                    if at > self.far:
                        self.far = at
                    return ()
                out: set[int] = set()
                for r in runs:
                    out.update(r(at))
                return tuple(out)

            return alt
        inner = self._compile(x)
        first, _ = self._first_of(x)
        if kind == "?":

            def opt(at: int) -> tuple[int, ...]:
                if self.stream[at] not in first:
                    return (at,)
                ends = inner(at)
                return ends if at in ends else (*ends, at)

            return opt
        least = kind == "+"

        def many(at: int) -> tuple[int, ...]:
            seen = set() if least else {at}
            front = [at]
            while front:
                b = front.pop()
                if self.stream[b] not in first:
                    if b > self.far:
                        self.far = b
                    continue
                for e in inner(b):
                    if e not in seen:
                        seen.add(e)
                        front.append(e)
            return tuple(seen)

        return many

    def load(self, stream: str, after: str = END) -> None:
        """Start an empty chart over ``stream``; ``after`` is the token that follows it."""
        self.stream = stream + after
        self.far = 0
        for c in self._chart.values():
            c.clear()

    def ends(self, rule: str, at: int = 0) -> tuple[int, ...]:
        return self._run[rule](at)

    def accepts(self, rule: str, stream: str, after: str = END) -> bool:
        """Whether the whole stream derives from ``rule``."""
        self.load(stream, after)
        return len(stream) in self.ends(rule)
