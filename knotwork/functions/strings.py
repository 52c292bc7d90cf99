"""Scalar functions over text: file stems, topic labels, markup, links, likeness of short names. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_stem(link: Column) -> Column:
    """Last path part of a link or path without ``.pdf`` or ``.html``: the identity of a paper in all graphs."""
    return F.regexp_replace(F.element_at(F.split(link, "/"), -1), r"\.(pdf|html)$", "")


def underscored(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("_"))


def topic_label(uri: Column) -> Column:
    """Struct (label, abbreviation) of a topic address: its last part decoded, ``_`` as blank, without a bracketed end.

    The abbreviation is the bracketed end, null if there is none. Addresses that do not decode are taken as they stand.
    """
    last = F.element_at(F.split(uri, "[/#]"), -1)
    text = F.trim(F.lower(F.replace(F.coalesce(F.try_url_decode(last), last), F.lit("_"), F.lit(" "))))
    return F.struct(F.trim(F.regexp_replace(text, r"\s*\([^()]*\)$", "")).alias("label"), F.nullif(F.regexp_extract(text, r"\(([^()]*)\)$", 1), F.lit("")).alias("abbreviation"))


def abbreviates(short: Column, text: Column) -> Column:
    """Whether a shorter string stands for a text: its letters begin words of the text in order or go on in the same word.

    A final ``s`` is a plural and not looked for. Every letter becomes a step of one pattern, which the text must begin with.
    """
    stem = F.regexp_replace(short, "s+$", "")
    literal = F.regexp_replace(stem, r"([^\p{L}\p{N}])", r"\\$1")
    steps = F.regexp_replace(literal, r"(?<=[\p{L}\p{N}])(?=.)", r"(?:|.*\\W)")
    return (F.length(short) < F.length(text)) & (F.length(stem) > 0) & F.rlike(text, F.concat(F.lit("^"), steps))


def scanned_words(c: Column) -> Column:
    """Text read from a picture with ASCII letters, digits and single blanks only."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[^\x20-\x7e]", ""), r"\W+", " "))


def tagged(c: Column, tag: str) -> Column:
    """Text within ``<tag>`` and ``</tag>``, the first one; null if there is none."""
    return F.nullif(F.regexp_extract(c, f"<{tag}>(.+?)</{tag}>", 1), F.lit(""))


def archive_link(c: Column, branch: str = "master") -> Column:
    """Address of the archive of a code repository from that of its page."""
    page = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"/+$", ""), r"\.git$", "")
    return F.concat(page, F.lit(f"/archive/{branch}.zip"))


def kept_words(words: Column) -> Column:
    """Words that neither hold nor stand in a word kept before them, in their order."""
    new = lambda kept, w: ~F.exists(kept, lambda k: F.contains(k, w) | F.contains(w, k))
    return F.aggregate(words, F.array().cast("array<string>"), lambda kept, w: F.when(new(kept, w), F.concat(kept, F.array(w))).otherwise(kept))


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common substring of two short strings, 0 if there is none or one is null."""
    ends = lambda i: F.transform(F.sequence(F.lit(1), F.length(a) - i + 1), lambda k: F.when(F.contains(b, F.substring(a, i, k)), k).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.length(a)), lambda i: F.array_max(ends(i))))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), best).otherwise(0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
