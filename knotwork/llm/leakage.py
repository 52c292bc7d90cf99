"""Passages of evaluation items in training documents (problem 7).

Each training shard (a run of documents of a partition, up to ``SHARD_WORDS`` words) gets an FM-index over word
numbers: a suffix array by prefix doubling, its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix
positions. All distinct phrases of ``PHRASE`` words of all items are searched backwards at once through wavelet ranks;
their occurrences are located by walking to the next sampled suffix. Words that no item has can match nothing, so a
run of them is one separator; separators and document ends are symbols of their own, which also keeps suffix sorting
short on repeated texts. Occurrences that gather near one diagonal of a (document, item) pair are then checked
exactly: maximal common runs of three words or more are chained, gaps costing score, and the item words inside the
best chain are counted. Hits are listed for whole documents at a time within ``BLOCK``, and not at all for items that are
too long for the hits of a document, so a stock sentence of all items needs time but no more memory. Overlapping spans of a document are merged for removal.

The items are a fixed table; their number and size are checked before they are sent to the executors. Documents are
read once and need no shuffle; only found pairs leave a task. Documents are indexed whole, whatever their length.

Defined results: null and blank texts hold nothing; an item of fewer than ``PHRASE`` words is matched as one phrase;
items without a word are never found; equal texts are found under each doc_id; repeated rows give one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a searched phrase, words of a shard, distance of sampled suffix positions.
PHRASE, SHARD_WORDS, SAMPLE = 6, 1_000_000, 8
#: Share of an item's words that must stand in the document.
SHARE = 1 / 3
#: Share of an item's words that whole phrases must cover near one diagonal before the exact check.
SEEDED = 0.12
#: Hits (occurrences times items of the phrase) that are held in memory at once.
BLOCK = 4_000_000
#: Bounds of the item table.
MOST_ITEMS, MOST_ITEM_CHARS = 100_000, 64_000_000
#: Words that may lie between two runs of one passage, in the document and in the item.
GAP = 60
#: Least density of a passage in the item and in the document.
DENSE, DENSE_IN_TEXT = 0.6, 0.3

PAIRS = "doc_id long, item_id long, share double, first_word int, last_word int"

_HYPHEN = re.compile(r"[-‐‑­][ \t]*\r?\n[ \t>]*")
_OTHER = re.compile(r"[^\w]+")
_SPACE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Words in lower case without punctuation; words parted at a line end by a hyphen are joined."""
    if "-\n" in text or not text.isascii() or "-\r" in text:
        text = _HYPHEN.sub("", unicodedata.normalize("NFKC", text))
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    return text.lower().encode("utf-8", "replace").translate(_SPACE).split()


class Items:
    """The test items as word numbers, and their phrases with the places where they stand."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.text: list[list[int]] = []
        for item, text in rows:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text or "")]
            if w:
                self.ids.append(item)
                self.text.append(w)
        at: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, w in enumerate(self.text):
            n = min(PHRASE, len(w))
            for j in range(len(w) - n + 1):
                at.setdefault(tuple(w[j : j + n]), []).append((k, j))
        phrases = sorted(at, key=lambda p: (len(p), p))
        self.sizes = np.array([len(w) for w in self.text], np.int64)
        self.grams = [grams_of(w) for w in self.text]
        # phrases of one length as a matrix each; of every phrase the places where it stands, short items first
        self.groups = []
        for n in sorted({len(p) for p in phrases}):
            own = [p for p in phrases if len(p) == n]
            self.groups.append(np.array(own, np.int32))
        places = [sorted(at[p], key=lambda x: (len(self.text[x[0]]), x)) for p in phrases]
        self.start = np.cumsum([0, *map(len, places)])
        self.places = np.array([x for p in places for x in p], np.int32).reshape(-1, 2)
        self.order = np.repeat(np.arange(len(phrases)), np.diff(self.start)) * (1 << 32) + self.sizes[self.places[:, 0]] if len(phrases) else np.zeros(0, np.int64)


def grams_of(item: list[int]) -> dict[tuple[int, ...], list[int]]:
    """Places of every three words (or all, if fewer) of an item."""
    out: dict[tuple[int, ...], list[int]] = {}
    n = min(3, len(item))
    for j in range(len(item) - n + 1):
        out.setdefault(tuple(item[j : j + n]), []).append(j)
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Every 0 is a separator unlike any other, first by place; the last symbol must be 0."""
    n = len(text)
    seps = np.flatnonzero(text == 0)
    key = text.astype(np.int64) + len(seps)
    key[seps] = np.arange(len(seps))
    sa = np.argsort(key, kind="stable")
    sorted_key = key[sa]
    new = np.r_[True, sorted_key[1:] != sorted_key[:-1]]
    starts = np.flatnonzero(new)
    group = starts[np.cumsum(new) - 1]
    rank = np.empty(n, np.int64)
    rank[sa] = group
    slots = np.flatnonzero(~(new & np.r_[new[1:], True]))
    h = 1
    while len(slots):
        e = sa[slots]
        both = rank[e] * n + rank[e + h]
        order = np.argsort(both, kind="stable")
        e, both = e[order], both[order]
        sa[slots] = e
        new = np.r_[True, both[1:] != both[:-1]]
        rank[e] = slots[np.flatnonzero(new)][np.cumsum(new) - 1]
        slots = slots[~(new & np.r_[new[1:], True])]
        h *= 2
    return sa


class FMIndex:
    """Backward search and location in one shard; symbols are numbers from 1, 0 separates."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        n = self.n = len(text)
        sa = suffix_array(text)
        before = text[sa - 1]  # the symbol before suffix 0 is the last, a separator
        self.first = np.searchsorted(np.sort(text), np.arange(symbols + 2)).astype(np.int64)
        mark = (sa % SAMPLE == 0) | (before == 0)
        self.marked = np.r_[0, np.cumsum(mark)]
        self.sampled = sa[mark]
        self.bits = max(1, int(symbols).bit_length())
        self.levels, self.zeros = [], []
        cur = before.astype(np.int32)
        for b in range(self.bits - 1, -1, -1):
            bit = (cur >> b) & 1
            ones = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append(ones)
            self.zeros.append(n - int(ones[n]))
            one = bit.astype(bool)
            cur = np.concatenate((cur[~one], cur[one]))
        self.before = before

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low = np.zeros_like(at)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            ones, z = self.levels[k], self.zeros[k]
            one = (symbol >> b) & 1 == 1
            o, p = ones[at], ones[low]
            at = np.where(one, z + o, at - o)
            low = np.where(one, z + p, low - p)
        return at - low

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of a phrase that occurs, first place, place after the last) in the order of suffixes."""
        row = np.arange(len(phrases))
        c = phrases[:, -1].astype(np.int64)
        lo, hi = self.first[c], self.first[c + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            live = lo < hi
            row, lo, hi = row[live], lo[live], hi[live]
            c = phrases[row, k].astype(np.int64)
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
        live = lo < hi
        return row[live], lo[live], hi[live]

    def locate(self, place: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by steps back to a sampled one."""
        out = np.empty(len(place), np.int64)
        left = np.arange(len(place))
        steps = 0
        while len(left):
            hit = self.marked[place + 1] > self.marked[place]
            out[left[hit]] = self.sampled[self.marked[place[hit]]] + steps
            left, place = left[~hit], place[~hit]
            c = self.before[place].astype(np.int64)
            place = self.first[c] + self.rank(c, place)
            steps += 1
        return out


def common_runs(item: list[int], grams: dict, doc: list[int]) -> list[list[int]]:
    """Maximal common runs of three words or more as (start in the item, start in the document, length), by their start in the document."""
    n = min(3, len(item))
    runs: list[list[int]] = []
    open_runs: dict[int, list[int]] = {}
    for j in range(len(doc) - n + 1):
        now: dict[int, list[int]] = {}
        for i in grams.get(tuple(doc[j : j + n]), ()):
            run = open_runs.get(i - 1)
            if run is None:
                run = [i, j, n]
                runs.append(run)
            else:
                run[2] += 1
            now[i] = run
        open_runs = now
    return runs


def _link(earlier: list[int], i: int, j: int, size: int) -> tuple[float, int] | None:
    """What a run adds to a chain that ends in an earlier run: (score, words), or None if it can't follow it."""
    a, b, w = earlier
    di, dj = i - (a + w), j - (b + w)
    over = max(0, -di, -dj)
    if di > GAP or dj > GAP or i <= a or j <= b or over >= size:
        return None
    gi, gj = max(0, di), max(0, dj)
    return size - over - 0.6 * gi - 0.15 * gj, size - over + (gi if gi <= 4 and gj <= 8 else 0)


def best_chain(runs: list[list[int]]) -> tuple[float, int, int, int, int]:
    """(score, words, first word in document and in item, number of the last run) of the best chain of runs.

    A run can only follow one that ends at most ``GAP`` words before it. Runs stay in reach of later ones until their
    end is further back than that, whatever begins between.
    """
    state: list[tuple[float, int, int, int]] = []
    best = (0.0, 0, 0, 0, -1)
    reach: list[int] = []
    for k, (i, j, size) in enumerate(runs):
        reach = [m for m in reach if j - (runs[m][1] + runs[m][2]) <= GAP]
        score, held, first, begin = float(size), size, j, i
        for m in reversed(reach):
            if state[m][0] + size <= score:
                continue
            more = _link(runs[m], i, j, size)
            if more and state[m][0] + more[0] > score:
                score, held, first, begin = state[m][0] + more[0], state[m][1] + more[1], state[m][2], state[m][3]
        state.append((score, held, first, begin))
        reach.append(k)
        if score > best[0]:
            best = (score, held, first, begin, k)
    return best


def chains_one_by_one(runs: list[list[int]]) -> Iterator[tuple[float, int]]:
    """Score and words of the best chain that ends in each run, looked up in all runs before it; the measure for tests."""
    state: list[tuple[float, int]] = []
    for k, (i, j, size) in enumerate(runs):
        best = (float(size), size)
        for m in range(k):
            more = _link(runs[m], i, j, size)
            if more and state[m][0] + more[0] > best[0]:
                best = (state[m][0] + more[0], state[m][1] + more[1])
        state.append(best)
        yield best


def passage(item: list[int], grams: dict, doc: list[int], base: int = 0) -> tuple[int, int, int]:
    """(item words inside the best chain of common runs, its first and last word in ``doc``)."""
    runs = common_runs(item, grams, doc)
    _, held, first, begin, k = best_chain(runs)
    if k < 0:
        return 0, base, base
    i, j, size = runs[k]
    # a copied passage is dense in the item; words met by chance are strewn over it
    if held < DENSE * (i + size - begin) or held < DENSE_IN_TEXT * (j + size - first):
        return 0, base, base
    return held, base + first, base + j + size - 1


def _shard(items: Items, docs: list[np.ndarray]) -> Iterator[tuple[int, int, float, int, int]]:
    """(document of the shard, item, share, first and last word) for each pair above the share."""
    flat = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int32))])
    owner = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    starts = np.cumsum([0, *(len(d) + 1 for d in docs)])
    keep = np.r_[True, (flat[1:] != 0) | (flat[:-1] != 0)]
    kept = np.flatnonzero(keep)
    text = flat[kept]
    if not text.any():
        return
    index = FMIndex(text, len(items.number))
    where, phrase, before = [], [], 0
    for phrases in items.groups:
        row, lo, hi = index.search(phrases)
        count = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(row) else np.zeros(0, np.int64)
        where.append(kept[index.locate(at)])
        phrase.append(np.repeat(row, count) + before)
        before += len(phrases)
    del index
    position, phrase = np.concatenate(where), np.concatenate(phrase)
    turn = np.argsort(position, kind="stable")
    position, phrase = position[turn], phrase[turn]
    doc = owner[position]
    # a document can only hold items that its hits together could cover: longer items are not even listed
    covers = np.bincount(doc, minlength=len(docs)) + PHRASE
    longest = np.floor(covers[doc] / SEEDED).astype(np.int64)
    many = np.searchsorted(items.order, phrase * (1 << 32) + longest, side="right") - items.start[phrase]
    # whole documents at a time, so that what is listed stays in bounds; a phrase that all items have makes more blocks
    total = np.cumsum(many)
    first = 0
    while first < len(doc):
        limit = (total[first - 1] if first else 0) + BLOCK
        last = int(np.searchsorted(total, limit, side="right"))
        last = int(np.searchsorted(doc, doc[max(last - 1, first)], side="right")) if last < len(doc) else len(doc)
        part = slice(first, last)
        yield from _block(items, docs, starts, len(flat), doc[part], position[part], phrase[part], many[part])
        first = last


def _block(items: Items, docs: list[np.ndarray], starts: np.ndarray, size: int, doc: np.ndarray, position: np.ndarray, phrase: np.ndarray, many: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """The pairs of the documents of a block, from the places of their phrases."""
    which = np.repeat(items.start[phrase] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    doc, position = np.repeat(doc, many), np.repeat(position, many)
    item, place = items.places[which, 0].astype(np.int64), items.places[which, 1].astype(np.int64)
    if not len(item):
        return
    # hits near one diagonal: blocks of 64 diagonals, each hit in two overlapping ones
    pair = doc * len(items.ids) + item
    block = (position - place) // 32
    width = size // 32 + 64
    span = np.minimum(PHRASE, items.sizes)[item]
    candidates = []
    for shift in (0, 1):
        key = pair * width + (block + shift) // 2 + 16
        turn = np.lexsort((place, key))
        k, p, w = key[turn], place[turn], span[turn]
        new = np.r_[True, k[1:] != k[:-1]]
        # item words that the hits of a block cover: each adds what lies beyond the hit before it
        adds = np.where(new, w, np.minimum(w, np.r_[0, np.diff(p)]))
        group = np.cumsum(new) - 1
        covered = np.bincount(group, adds)
        good = covered >= SEEDED * items.sizes[item[turn[new]]]
        candidates.append(turn[good[group]])
    chosen = np.unique(np.concatenate(candidates))
    order = chosen[np.lexsort((position[chosen], pair[chosen]))]
    bounds = np.flatnonzero(np.r_[True, pair[order][1:] != pair[order][:-1], True])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        d, i = int(doc[order[a]]), int(item[order[a]])
        own = position[order[a:b]] - starts[d]
        length = len(items.text[i])
        spans = []
        # hits further apart than a passage can reach are looked at one by one
        for part in np.split(own, np.flatnonzero(np.diff(own) > length + 4 * GAP) + 1):
            begin = max(0, int(part[0]) - length - GAP)
            spans += _passages(items.text[i], items.grams[i], docs[d][begin : int(part[-1]) + length + GAP].tolist(), begin)
        for held, first, last in sorted(set(spans), key=lambda x: x[1:]):
            yield d, items.ids[i], held / length, first, last


def _passages(item: list[int], grams: dict, doc: list[int], base: int) -> Iterator[tuple[int, int, int]]:
    """Every disjoint passage that holds enough of the item: the best one, then those before and after it."""
    todo = [(0, len(doc))]
    while todo:
        a, b = todo.pop()
        held, first, last = passage(item, grams, doc[a:b], base + a)
        if held and held >= SHARE * len(item):
            yield held, first, last
            todo += [(a, first - base), (last + 1 - base, b)]


def _task(rows: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows.value)
        ids: list[int] = []
        docs: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            out = [(ids[d], *rest) for d, *rest in _shard(items, docs)]
            ids.clear()
            docs.clear()
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "share", "first_word", "last_word"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                if not w:
                    continue
                ids.append(doc)
                docs.append(np.fromiter(map(items.number.get, w, repeat(0)), np.int32, len(w)))
                held += len(w)
                if held >= SHARD_WORDS:
                    yield flush()
                    held = 0
        if docs and items.ids:
            yield flush()

    return run


def pairs(documents: DataFrame, eval_item: DataFrame) -> DataFrame:
    """doc_id, item_id, share of the item's words that the document holds, and the span of words that holds them."""
    items = eval_item.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    count, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    if count > MOST_ITEMS or size > MOST_ITEM_CHARS:
        raise ValueError(f"{count} items of {size} characters are more than is sent to each executor")
    rows = sorted((int(i), t) for i, t in items.collect())
    docs = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return docs.mapInArrow(_task(documents.sparkSession.sparkContext.broadcast(rows)), PAIRS)


def found(documents: DataFrame, eval_item: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of every item that leaked into a document."""
    return pairs(documents, eval_item).select("doc_id", "item_id").distinct()


def removal_spans(documents: DataFrame, eval_item: DataFrame) -> DataFrame:
    """Spans of words to remove per document, overlapping or touching ones merged."""
    spans = pairs(documents, eval_item).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first_word", "last_word"))).alias("s"))
    one = lambda x: F.array(x)
    last = lambda a: F.element_at(a, -1)
    merge = lambda a, x: F.when(
        (F.size(a) > 0) & (x["first_word"] <= last(a)["last_word"] + 1),
        F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), one(F.struct(last(a)["first_word"].alias("first_word"), F.greatest(last(a)["last_word"], x["last_word"]).alias("last_word")))),
    ).otherwise(F.concat(a, one(x)))
    merged = F.aggregate("s", F.slice("s", 1, 0), merge)
    return spans.select("doc_id", F.explode(merged).alias("m")).select("doc_id", "m.first_word", "m.last_word")
