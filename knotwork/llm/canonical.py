"""Free-entered layer names mapped to the entries of the reference list (problem 3).

A set-similarity join by prefix filter. Both sides become sets of letter pairs of their words (word ends marked,
letters that scanners confuse folded). Pairs are ordered by global rarity over the reference list; a record is looked
up under the pairs of its prefix only, candidates pass the length and the positional filter, and their Jaccard
similarity is computed exactly. Candidates are taken from the highest similarity down; the first whose words agree one
by one with the text (an exact check by edit distance, in either word order, cut short, or run together) gives the
entry, and edit distance decides between equal similarities only. A text whose words are those of an entry has
similarity 1 and is looked up at once.

A reference list of up to ``MOST_ENTRIES`` rows is sent to every task as an index and the mentions are read once where
they lie: no shuffle of mentions, no skew of a text or directory that holds a third of all rows, equal texts matched
once per task. A longer list is joined with the distinct texts on the pairs of both prefixes (:func:`wide`); only the
order of pairs, as many as two letters can make, is sent to the tasks. Word forms that the list shows for one entry
(``attn`` for ``attention``) are learned from all entries and offered for every entry.

Defined results: null and blank texts give no row; a text without a letter, or with other words than those of an entry
besides additions such as articles, numbers or ``layer``, is ``unmatched``; an entry of one word is matched like any
other; repeated rows give one row; ties go to the entry that sorts first; an empty reference list leaves everything
unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.session import stage_table

#: Least Jaccard similarity of letter pairs for the exact check.
SIMILAR = 0.4
#: Most reference rows that are sent to the tasks, and most texts remembered in one.
MOST_ENTRIES, REMEMBERED = 200_000, 500_000

UNMATCHED = "unmatched"

# Words that say nothing about which layer is meant.
ADDITIONS = frozenset(
    "a an the our this that its their his her my these those one each every some any new proposed standard simple single "
    "layer layers block blocks module modules unit units op ops operation operations operator operators step steps stage component components "
    "d ch k x s px dim dims".split()
)
_FOLD = str.maketrans({"0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "3": "e", "4": "a", "5": "s", "$": "s", "6": "b", "7": "t", "8": "b", "9": "g", "j": "l"})
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z][a-z])|(?<=[A-Za-z])(?=\d+[dD]\b)")
_BRACKET = re.compile(r"\([^()]*=[^()]*\)|\(\s*\d+(?:\s*[x×,]\s*\d+)*\s*\)|\[\s*\d+(?:[\s,;–-]*\d+)*\s*\]")
_NUMBER = re.compile(r"[x×]?\d+(?:[.,]\d+)?(?:[x×]\d+)*(?:d|ch|px|k|x)?|k=\d+|v\d+")


def tokens(text: str) -> list[str]:
    """Words of a name in lower case, without additions; a word cut short keeps its full stop off."""
    text = unicodedata.normalize("NFKC", text).replace("­", "")
    text = _BRACKET.sub(" ", text)
    text = _CAMEL.sub(" ", text).lower()
    words = re.split(r"[\s_\-‐‑–—/,;:()\[\]{}<>\"'`“”‘’«»*+#~.?]+", text)
    return [w for w in words if w and w not in ADDITIONS and not _NUMBER.fullmatch(w)]


def fold(word: str) -> str:
    return word.translate(_FOLD)


def pairs(words: list[str]) -> frozenset[str]:
    return frozenset(p for w in words for p in map("".join, zip("^" + w, w + "$", strict=True)))


def distance(a: str, b: str, most: int) -> int:
    """Edits (with swaps of neighbours) from a to b, or more than ``most``."""
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


def _allowed(size: int) -> int:
    return 0 if size < 3 else 1 if size < 6 else 2 if size < 12 else 3


def word_cost(t: str, v: str) -> int:
    """Cost of reading word ``t`` as ``v``: edits, or 1 for a word cut short; 99 if it can't be read so."""
    if t == v:
        return 0
    most = _allowed(min(len(t), len(v)))
    d = distance(t, v, most)
    if d <= most:
        return d
    if 4 <= len(t) < len(v) and distance(t, v[: len(t)], 1) <= (1 if len(t) >= 7 else 0):
        return 2
    return 99


def reading_cost(words: list[str], entry: tuple[str, ...]) -> int:
    """Cost of reading the words as the words of an entry, in order, rotated, or run together; 99 if impossible."""
    best = 99
    n = len(entry)
    if len(words) == n:
        for k in range(n):
            turned = entry[k:] + entry[:k]
            best = min(best, sum(word_cost(t, v) for t, v in zip(words, turned, strict=True)))
    if best >= 99 and words and abs(len(words) - n) <= 1:
        glued = "".join(words)
        for k in range(n):
            whole = "".join(entry[k:] + entry[:k])
            d = distance(glued, whole, 2)
            if d <= 2:
                best = min(best, d + 1)
    return best if best < 99 else 99


def word_forms(variant: str, entry: str) -> list[tuple[str, tuple[str, ...]]]:
    """(word of the entry, other words) where a variant has other words in its place."""
    v, e = tokens(variant), tokens(entry)
    out = []
    if len(e) > 1 and sorted(v) != sorted(e):
        for k, word in enumerate(e):
            rest = list(v)
            if all(x in rest and not rest.remove(x) for j, x in enumerate(e) if j != k) and rest:
                out.append((word, tuple(rest)))
    return out


def prefix(size: int) -> int:
    """How many of the rarest pairs of a set must be looked up."""
    return size - -(-SIMILAR * size // 1).__trunc__() + 1


def ordered(s: frozenset[str], rarity: dict[str, int]) -> list[str]:
    return sorted(s, key=lambda p: (rarity.get(p, 0), p))


def may_be_similar(size: int, at: int, n: int, there: int) -> bool:
    """Length filter, and positional filter: what is left after the first shared pair bounds the overlap."""
    return n >= SIMILAR * size and size >= SIMILAR * n and 1 + min(size - at - 1, n - there - 1) >= SIMILAR / (1 + SIMILAR) * (size + n)


def best_reading(words: list[str], own: frozenset[str], candidates: list[tuple[str, tuple[str, ...], frozenset[str]]]) -> str:
    """Entry of the most similar candidate (entry, folded words, pairs) that the words can be read as."""
    found = []
    for entry, form, other in candidates:
        both = len(own & other)
        jaccard = both / (len(own) + len(other) - both)
        if jaccard >= SIMILAR:
            found.append((-jaccard, entry, form))
    best = (0.0, 99, UNMATCHED)
    for negative, entry, form in sorted(found):
        if best[1] < 99 and negative > best[0]:
            break
        cost = reading_cost(words, form)
        if cost < 99 and (best[1] == 99 or (cost, entry) < best[1:]):
            best = (negative, cost, entry)
    return best[2]


class Index:
    """Reference entries under the letter pairs of their prefixes."""

    def __init__(self, rows: list[tuple[str, str]]) -> None:
        forms: dict[tuple[str, ...], str] = {}
        plain = {entry: tuple(tokens(entry)) for _, entry in rows}
        other: dict[str, set[tuple[str, ...]]] = {}
        for variant, entry in rows:
            for word, form in word_forms(variant, entry):
                other.setdefault(word, set()).add(form)
        for variant, entry in sorted(rows):
            forms.setdefault(tuple(tokens(variant)), entry)
        for entry, e in sorted(plain.items()):
            forms.setdefault(e, entry)
            for k, word in enumerate(e):
                for form in sorted(other.get(word, ())):
                    forms.setdefault(e[:k] + form + e[k + 1 :], entry)
        forms.pop((), None)
        self.exact = {tuple(sorted(f)): e for f, e in sorted(forms.items(), reverse=True)}
        self.forms = [(tuple(map(fold, f)), e) for f, e in sorted(forms.items())]
        self.sets = [pairs(list(f)) for f, _ in self.forms]
        self.rarity: dict[str, int] = {}
        for s in self.sets:
            for p in s:
                self.rarity[p] = self.rarity.get(p, 0) + 1
        self.under: dict[str, list[tuple[int, int]]] = {}
        for k, s in enumerate(self.sets):
            for at, p in enumerate(ordered(s, self.rarity)[: prefix(len(s))]):
                self.under.setdefault(p, []).append((k, at))

    def entry(self, text: str) -> str:
        words = tokens(text)
        if len(words) == 0 or not any(c.isalpha() for w in words for c in w):
            return UNMATCHED
        hit = self.exact.get(tuple(sorted(words)))
        if hit is not None:
            return hit
        words = [fold(w) for w in words]
        own = pairs(words)
        size = len(own)
        seen: set[int] = set()
        for at, p in enumerate(ordered(own, self.rarity)[: prefix(size)]):
            seen.update(k for k, there in self.under.get(p, ()) if k not in seen and may_be_similar(size, at, len(self.sets[k]), there))
        return best_reading(words, own, [(self.forms[k][1], self.forms[k][0], self.sets[k]) for k in seen])


def _task(rows: list[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rows)
        known: dict[str, str] = {}
        for b in batches:
            out = []
            for text in b.column("entitytext").to_pylist():
                entry = known.get(text)
                if entry is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    entry = known[text] = index.entry(text)
                out.append(entry)
            yield pa.RecordBatch.from_arrays([b.column("entity_id"), pa.array(out, pa.string())], ["entity_id", "layer_type"])

    return run


def _python(columns: dict[str, pa.DataType], make) -> object:
    """A task for ``mapInArrow`` that makes rows (tuples) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [new for row in zip(*(c.to_pylist() for c in b.columns), strict=True) for new in make(*row)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(columns.values())], list(columns))

    return run


def wide(mentions: DataFrame, listed: DataFrame) -> DataFrame:
    """As the index in every task, for reference lists of any length: a join of distinct texts and forms on pairs."""
    text, number = pa.string(), pa.int32()
    replaced = listed.mapInArrow(_python({"word": text, "form": text}, lambda v, e: ((w, " ".join(f)) for w, f in word_forms(v, e))), "word string, form string").distinct()
    words = listed.select("layer_type").distinct().mapInArrow(
        _python({"layer_type": text, "word": text, "at": number}, lambda e: ((e, w, k) for k, w in enumerate(tokens(e)))), "layer_type string, word string, at int"
    )
    swapped = words.join(replaced, "word").select("layer_type", "at", "form").mapInArrow(
        _python({"form": text, "layer_type": text}, lambda e, k, f: [(" ".join([*tokens(e)[:k], f, *tokens(e)[k + 1 :]]), e)]), "form string, layer_type string"
    )
    plain = listed.mapInArrow(_python({"form": text, "layer_type": text, "rank": number}, lambda v, e: [(" ".join(tokens(v)), e, 0), (" ".join(tokens(e)), e, 1)]), "form string, layer_type string, rank int")
    forms = plain.unionByName(swapped.withColumn("rank", F.lit(2))).filter("form <> ''").groupBy("form").agg(F.min(F.struct("rank", "layer_type")).alias("m")).select("form", F.col("m.layer_type").alias("layer_type"))
    forms = stage_table(forms, "forms")
    folded = lambda t: [fold(w) for w in t.split(" ")]
    # the order of pairs by rarity: as many rows as there are pairs of letters
    letters = forms.mapInArrow(_python({"p": text}, lambda f, e: ((p,) for p in pairs(folded(f)))), "p string").groupBy("p").count()
    rarity = {r[0]: r[1] for r in letters.collect()}
    keys = {"key": text, "at": number, "size": number, "own": text}

    def under(t: str) -> Iterator[tuple]:
        s = pairs(folded(t)) if t else frozenset()
        return ((p, k, len(s), t) for k, p in enumerate(ordered(s, rarity)[: prefix(len(s))]) if s)

    shape = "key string, at int, size int, own string"
    texts = stage_table(mentions.select("entitytext").distinct().mapInArrow(_python({"entitytext": text, "own": text}, lambda t: [(t, " ".join(tokens(t)))]), "entitytext string, own string"), "texts")
    # a pair of letters that very many forms have is split by the size of their sets, which the length filter bounds
    left = texts.select("own").distinct().mapInArrow(_python(keys, under), shape).withColumn("n", F.explode(F.sequence(F.ceil(F.col("size") * SIMILAR), F.floor(F.col("size") / SIMILAR)))).withColumn("n", F.col("n").cast("int"))
    right = forms.select("form").mapInArrow(_python(keys, under), shape).select("key", F.col("at").alias("there"), F.col("size").alias("n"), F.col("own").alias("form"))
    overlap = 1 + F.least(F.col("size") - F.col("at") - 1, F.col("n") - F.col("there") - 1) >= SIMILAR / (1 + SIMILAR) * (F.col("size") + F.col("n"))
    met = left.join(right, ["key", "n"]).filter(overlap).select("own", "form").distinct().join(forms, "form")

    def verified(own: str, form: str, entry: str) -> Iterator[tuple]:
        a, b = own.split(" "), form.split(" ")
        x, y = pairs([fold(w) for w in a]), pairs([fold(w) for w in b])
        same = len(x & y) / len(x | y)
        if any(c.isalpha() for c in own) and same >= SIMILAR:
            exact = sorted(a) == sorted(b)
            cost = 0 if exact else reading_cost([fold(w) for w in a], tuple(fold(w) for w in b))
            if cost < 99:
                yield own, -2.0 if exact else -same, cost, entry

    kinds = {"own": text, "negative": pa.float64(), "cost": number, "entry": text}
    best = met.select("own", "form", "layer_type").mapInArrow(_python(kinds, verified), "own string, negative double, cost int, entry string").groupBy("own").agg(F.min(F.struct("negative", "cost", "entry")).alias("b"))
    told = texts.join(best, "own", "left").select("entitytext", F.coalesce("b.entry", F.lit(UNMATCHED)).alias("layer_type"))
    return mentions.join(told, "entitytext").select("entity_id", "layer_type")


def found(entity: DataFrame, standard: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """(entity_id, layer_type) for every mention with text; ``unmatched`` where the list has no such layer."""
    listed = standard.filter("variant is not null and layer_type is not null").select("variant", "layer_type").distinct()
    mentions = entity.filter(F.rlike("entitytext", F.lit(r"[^\s ​]")) & F.col("entity_id").isNotNull()).select("entity_id", "entitytext")
    rows = sorted(map(tuple, listed.limit(most + 1).collect()))
    if len(rows) > most:
        return wide(mentions, listed).distinct()
    return mentions.mapInArrow(_task(rows), "entity_id long, layer_type string").distinct()


def report(entity: DataFrame, standard: DataFrame) -> DataFrame:
    """Mentions per entry, unmatched ones included."""
    return found(entity, standard).groupBy("layer_type").agg(F.count(F.lit(1)).alias("mentions"))
