"""Text statistics per document and the documents that are not natural prose (problem 8).

Statistics are built-in expressions over the text (regular expressions, higher-order functions), so each document is
read once in the JVM without a shuffle, whatever its length, and without Python. The verdict is an ordered rule list
learned by incremental reduced-error pruning: rules are grown one condition at a time by information gain on two
thirds of the labelled documents, pruned on the last third, and added until a rule errs too often on it. The
learned thresholds become one SQL CASE expression. Labelled documents are written by ``examples``: a bounded sample
(``EXAMPLES``, a parameter) of invented prose in several languages and layouts, of lists, tables, logs, menus,
keywords, code, encoded and garbled text and repeated phrases, and of mixtures, labelled by what most of it is.

Defined results: null and blank texts have null statistics and are never found; a text without a letter has zero words
and is not prose; equal texts get equal verdicts; ``lang``, ``n_chars`` and other columns are not read.
"""

from __future__ import annotations

import base64
import math
import random
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents, and the seed they are written with.
EXAMPLES, SEED = 6000, 7
#: A rule is dropped whose right less wrong cases are a smaller share of what it covers of the last third; induction
#: ends after so many dropped rules in a row.
LEAST_WORTH, TRIES = 0.7, 10
#: Largest list of common words that is put into an expression as a hash set.
MOST_WORDS = 5000

FEATURES = (
    "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punct_share", "common_share", "vocabulary", "prose_share", "words_per_line", "sentence_variety",
)

def common_words(common_word: DataFrame) -> tuple[str, ...]:
    """The listed words of two letters or more; the list is fixed and its size is checked."""
    words = sorted({r[0].lower() for r in common_word.select("word").filter("length(word) > 1").distinct().limit(MOST_WORDS + 1).collect()})
    if len(words) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return tuple(words)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def statistics(documents: DataFrame, common: tuple[str, ...], text: str = "text") -> DataFrame:
    """The rows with the statistics of ``FEATURES`` as columns, null for null and blank texts.

    Three passes of regular expressions shrink a text to its shape (``w`` for a word, ``0`` for a digit, ``o`` for a
    symbol that plain sentences lack); most counts are then differences of lengths over that shape. Common words are
    looked up in a hash set.
    """
    low = F.when(F.rlike(F.col(text), F.lit(r"[^\s\u00a0\u200b\ufeff]")), F.lower(F.col(text)))
    shape = F.col("_low")
    for pattern, char in ((r"[\p{L}\p{M}]++", "w"), (r"\p{N}", "0"), (r"[^w0\s.,;:'’()\"“”!?\-\[\]%]", "o")):
        shape = F.regexp_replace(shape, pattern, char)
    flat = documents.withColumn("_low", low).withColumn("_s", shape)
    rows = F.arrays_zip(F.split("_s", "\n").alias("s"), F.split("_low", "\n").alias("t"))
    rows = F.filter(rows, lambda x: F.length(F.trim(x["s"])) > 0)
    flat = flat.withColumn("_rows", F.transform(rows, lambda x: F.struct(x["s"].alias("s"), F.length(F.trim(x["t"])).alias("size"), F.split(x["t"], r"[^\p{L}\p{M}]+").alias("w"))))
    listed = (lambda w: w.isin(*common)) if common else (lambda w: F.lit(False))
    line = lambda x: F.struct(
        x["size"].alias("size"),
        _count(x["s"], "w").alias("words"),
        F.size(F.filter(x["w"], listed)).alias("common"),
        _count(x["s"], "o").alias("odd"),
        F.substring(F.rtrim(x["s"], F.lit("\"'”’)] \t\r")), -1, 1).isin(*".!?…。！？").alias("ends"),
    )
    prose = lambda x: (x["words"] >= 3) & (x["common"] * 5 >= x["words"]) & (x["odd"] * 40 <= x["size"])
    # of all lines: characters, characters of lines that read like prose, lines that end a sentence, common words
    sums = F.aggregate(
        F.transform("_rows", line),
        F.struct(*(F.lit(0).alias(k) for k in ("size", "prose", "ends", "common"))),
        lambda a, x: F.struct(
            (a["size"] + x["size"]).alias("size"),
            (a["prose"] + F.when(prose(x), x["size"]).otherwise(0)).alias("prose"),
            (a["ends"] + F.when(x["ends"], 1).otherwise(0)).alias("ends"),
            (a["common"] + x["common"]).alias("common"),
        ),
    )
    blank = _count(F.col("_s"), " ") + _count(F.col("_s"), "\n") + _count(F.col("_s"), "\t") + _count(F.col("_s"), "\r")
    flat = flat.withColumns(
        {
            "_n": _count(F.col("_s"), "w"),
            "_digits": _count(F.col("_s"), "0"),
            "_blank": blank,
            "_v": F.size(F.array_distinct(F.flatten("_rows.w"))).cast("double"),
            "_sums": sums,
            "_size": F.length("_s"),
            "_length": F.length("_low"),
        }
    ).withColumn("_symbols", F.col("_size") - F.col("_n") - F.col("_digits") - F.col("_blank"))
    n = F.col("_n")
    sentences = F.split("_low", r"[.!?\n]+\s*")
    solid = F.greatest(F.col("_length") - F.col("_blank"), F.lit(1))
    values = {
        "n_words": n.cast("double"),
        "mean_word_length": _share(F.greatest(solid - F.col("_digits") - F.col("_symbols"), F.lit(0)), n),
        "symbol_ratio": _share(F.col("_symbols"), solid),
        "digit_ratio": _share(F.col("_digits"), solid),
        "end_punct_share": _share(F.col("_sums.ends"), F.size("_rows")),
        "common_share": _share(F.col("_sums.common"), n),
        "vocabulary": F.when(n > 1, F.ln("_v") / F.ln(n.cast("double") + 1)).otherwise(F.lit(1.0)),
        "prose_share": _share(F.col("_sums.prose"), F.col("_sums.size")),
        "words_per_line": _share(n, F.size("_rows")),
        # only a text of few different words can say one thing over and over
        "sentence_variety": F.when((n > 1) & (F.ln("_v") / F.ln(n.cast("double") + 1) < 0.85), _share(F.size(F.array_distinct(sentences)), F.size(sentences))).otherwise(F.lit(1.0)),
    }
    out = flat.select(*documents.columns, *(F.when(F.col("_low").isNotNull(), F.round(v, 6)).alias(f"_f_{k}") for k, v in values.items()))
    return out.select(*(F.col(c) for c in documents.columns if c not in FEATURES), *(F.col(f"_f_{k}").alias(k) for k in FEATURES))


# --- labelled documents


def _word(r: random.Random) -> str:
    return "".join(r.choice("bcdfghjklmnprstvwz") + r.choice(["a", "e", "i", "o", "u", "ei", "ou", "er", "an", "or"]) for _ in range(r.choice((2, 2, 3, 3, 4)))) + r.choice(("", "", "s", "n", "ing", "ed"))


def _sentence(r: random.Random, small: list[str], stock: list[str]) -> str:
    share = r.uniform(0.36, 0.55)
    words = [r.choice(small) if r.random() < share else r.choice(stock) if r.random() < 0.9 else r.choice(stock).capitalize() + r.choice(("", f"-{r.randint(2, 99)}", "-" + r.choice("ABX"))) for _ in range(r.randint(7, 26))]
    for k in range(3, len(words) - 2, 6):
        if r.random() < 0.3:
            words[k] += r.choice((",", ",", ";"))
    tail = r.choice(("", "", "", " (p < 0.0%d)" % r.randint(1, 9), " [%d]" % r.randint(1, 99), " by %.1f%%" % r.uniform(1, 99), " (α = 0.5, β ≤ 1)"))
    text = " ".join(words)
    return text[0].upper() + text[1:] + tail + r.choice(".....?!")


def _prose(r: random.Random, languages: dict[str, list[str]], size: int) -> str:
    small = languages[r.choice([*languages, "en", "en", "en"]) if "en" in languages else r.choice([*languages])]
    stock = [_word(r) for _ in range(r.choice((9, 14, 25, 60, 300)))]
    if len(stock) < 20:
        small = r.sample(small, min(len(small), r.randint(6, 14)))
    out = []
    while sum(map(len, out)) < size:
        out.append(_sentence(r, small, stock))
    text = " ".join(out)
    look = r.random()
    if look < 0.15:
        text = text.upper()
    elif look < 0.25:
        text = "".join(c if r.random() > 0.03 else r.choice("abcdeiortx1l|") for c in text)
    elif look < 0.3:
        text = text.replace(" ", "  ")
    if r.random() < 0.35:
        width, rows, row = r.choice((38, 48, 60, 80)), [], ""
        for w in text.split(" "):
            if len(row) + len(w) > width:
                rows.append(row)
                row = w
            else:
                row = f"{row} {w}".strip()
        text = "\n".join([*rows, row])
    elif r.random() < 0.3:
        text = "\n".join(r.choice(("", "> ", "(%d) " % k)) + s for k, s in enumerate(out, 1))
    if r.random() < 0.15:
        text = text[: int(len(text) * r.uniform(0.8, 0.99))]
    if r.random() < 0.2:
        text = r.choice(("Overview", "## Results", "Abstract", "1 Introduction")) + "\n" + text
    return text


def _not_prose(r: random.Random, languages: dict[str, list[str]], size: int) -> str:
    kind = r.randrange(13)
    out: list[str] = []
    stock = [_word(r) for _ in range(r.choice((8, 30, 80)))]
    mark = r.choice(("- ", "* ", "", "– ", "• ", "%d. ", "%d) ", "[%d] ", "%d "))
    end = r.choice(("", "", ".", ",", ";"))
    menu = [w.capitalize() for w in r.sample(stock, min(8, len(stock)))] + ["Home", "About", "Sign up", "Log in", "Next >", "« Back", "© 2019", "All rights"]
    row_sep = r.choice(("\t", " | ", " & ", ",", ";", "   "))
    columns = r.randint(2, 7)
    phrase = " ".join(r.choice(stock if r.random() < 0.6 else languages[r.choice([*languages])]) for _ in range(r.randint(2, 9))) + r.choice((".", "!", ",", ""))
    number = lambda: r.choice(("%d" % r.randint(1, 999), "%.2f" % r.uniform(0, 99), "%.1f ± 0.%d" % (r.uniform(0, 99), r.randint(0, 9)), "-"))
    prep = [w for w in languages.get("en", ["with"]) if w in ("with", "for", "of", "in", "and", "the")] or ["with"]
    while sum(map(len, out)) + len(out) < size:
        k = len(out) + 1
        lead = mark % k if "%" in mark else mark
        if kind == 0:
            out.append(lead + " ".join(r.choice(stock) for _ in range(r.randint(1, 4))) + end)
        elif kind == 1:
            out.append(lead + f"{r.choice(stock).capitalize()}, {r.choice('ABCDEFG')}. " + " ".join(r.choice(stock).capitalize() for _ in range(r.randint(1, 3))) + f" {r.choice(prep)} " + " ".join(r.choice(stock).capitalize() for _ in range(r.randint(1, 3))) + f". {r.randint(1990, 2024)}" + end)
        elif kind == 2:
            out.append(row_sep.join([r.choice(stock).capitalize(), *(number() for _ in range(columns))]) + (" \\\\" if row_sep == " & " else ""))
        elif kind == 3:
            out.append(r.choice(("[%05d] step=%d lr=1e-%d loss=%.5f" % (k, r.randint(1, 999), r.randint(2, 9), r.random()), "%d: loss %.2f, val %.2f (%d ms)" % (k, r.random(), r.random(), r.randint(1, 999)), "2021-03-%02d 12:%02d:%02d INFO %s %s" % (r.randint(1, 28), k % 60, r.randint(0, 59), r.choice(stock), r.choice(stock)), "epoch %d/%d - %s: %.4f" % (k, 90, r.choice(stock), r.random()))))
        elif kind == 4:
            out.append(r.choice(menu))
        elif kind == 5:
            out.append(" ".join(r.choice(stock) for _ in range(r.randint(1, 3))))
        elif kind == 6:
            a, b, c = (r.choice(stock) for _ in range(3))
            out.append(r.choice((f"def {a}_{b}({c}, rate={r.randint(1, 99)}):", f"    {a} = {b}.{c}({a}, [{r.randint(1, 9)}, 0.5])", f"    for i, {a} in enumerate({b}):", f"        if {a} > {r.random():.2f}:", f"    return {a}", f"import {a} as {b}", f"  var {a} = {b} * {r.randint(1, 99)};", f"  if ({a} > 3) {{", "  }", f"function {a}({b}, {c}) {{", f"    print(\"{a} of {b}: %s\" % {a})", f"    # {a} the {b} before the {c}", f'    """{a.capitalize()} the {b} of one {c}."""')))
        elif kind == 7:
            raw = bytes(r.randrange(256) for _ in range(54))
            out.append(r.choice((base64.b64encode(raw).decode(), raw.hex()[:76], base64.b64encode(raw).decode())) if r.random() < 0.98 else "=" * r.randint(1, 2))
        elif kind == 8:
            letters = r.choice(("+=*#§°<>abcdefghijklmnopqrstuvwxyz", "|!;:,.~^1labcdefghinoprstuvy", "abcdefghijklmnopqrstuvwxyz", "éàüÃ©¤¢â€™œž¿½abcdefghi"))
            out.append(" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(r.choice((1, 8, 14)))))
        elif kind == 9:
            out.append(phrase)
        elif kind == 10:
            out.append(lead + r.choice(stock) + r.choice(("==", ">=", ": ", " = ")) + f"{r.randint(0, 9)}.{r.randint(0, 30)}" + end)
        elif kind == 11:
            out.append(lead + r.choice(stock).capitalize() + r.choice(("", f"-{r.randint(2, 99)}", " " + r.choice(stock).capitalize())) + f", {r.randint(1990, 2024)}" + end)
        else:
            out.append(r.choice((f'{{"{r.choice(stock)}": {r.randint(1, 99)}, "{r.choice(stock)}": "{r.choice(stock)}"}},', f"<tr><td>{r.choice(stock)}</td><td>{r.randint(1, 99)}</td></tr>", f"https://{r.choice(stock)}.example/{r.choice(stock)}/{r.randint(1, 999)}")))
    if kind == 9:
        return r.choice((" ", "\n")).join(out)
    if kind == 5:
        return r.choice((", ", "; ", " | ", " / ", " > ", "  ", " · ", ",")).join(out) + r.choice(("", ".", "."))
    if kind == 4 and r.random() < 0.3:
        return r.choice((" | ", "  ", " ")).join(out)
    if r.random() < 0.3 and kind in (0, 1, 2, 10, 11):
        out.insert(0, r.choice(("Topics:", "Contents", "Requirements", "References", "Layers used")))
    return "\n".join(out)


def examples(languages: dict[str, list[str]], count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, bool]]:
    """(text, whether it is for the most part not prose), half of each before a third is mixed with the other kind.

    A mixture takes the label of the larger part; mixtures near the half are left out.
    """
    r = random.Random(seed)
    out: list[tuple[str, bool]] = []
    while len(out) < count:
        bad = bool(len(out) % 2)
        size = int(math.exp(r.uniform(math.log(60), math.log(7000 if r.random() < 0.15 else 2000))))
        text = (_not_prose if bad else _prose)(r, languages, size)
        if r.random() < 0.45:
            other = (_prose if bad else _not_prose)(r, languages, int(r.uniform(0.08, 0.8) * len(text)))
            share = len(text) / (len(text) + len(other))
            if 0.44 < share < 0.56:
                continue
            text = r.choice(("\n", "\n\n")).join((other, text) if r.random() < 0.5 else (text, other))
            bad ^= share < 0.5
        out.append((text, bad))
    return out


# --- rule induction


def _covers(rule: list[tuple[int, bool, float]], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, below, at in rule:
        out &= (x[:, f] <= at) if below else (x[:, f] > at)
    return out


def _grow(x: np.ndarray, y: np.ndarray) -> list[tuple[int, bool, float]]:
    rule: list[tuple[int, bool, float]] = []
    inside = np.ones(len(x), bool)
    while True:
        p, n = int((inside & y).sum()), int((inside & ~y).sum())
        if not n or not p:
            return rule
        base, best = math.log2(p / (p + n)), (1e-9, None)
        xs, ys = x[inside], y[inside]
        for f in range(x.shape[1]):
            order = np.argsort(xs[:, f], kind="stable")
            v, pos = xs[order, f], np.cumsum(ys[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            lp, ln = pos[cut], cut + 1 - pos[cut]
            for below, cp, cn in ((True, lp, ln), (False, p - lp, n - ln)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(cp > 0, cp * (np.log2(cp / (cp + cn)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (f, below, float((v[cut[k]] + v[cut[k] + 1]) / 2)))
        if best[1] is None:
            return rule
        rule.append(best[1])
        inside = _covers(rule, x)


def induce(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> list[list[tuple[int, bool, float]]]:
    """Ordered rules for the class ``y`` by incremental reduced-error pruning; what no rule covers is the other class."""
    random_state = np.random.default_rng(seed)
    rules: list = []
    tries = 0
    while y.any() and len(x) > 9 and tries < TRIES:
        turn = random_state.permutation(len(x))
        cut = 2 * len(x) // 3
        gx, gy, px, py = x[turn[:cut]], y[turn[:cut]], x[turn[cut:]], y[turn[cut:]]
        rule = _grow(gx, gy)

        def worth(r: list, px: np.ndarray = px, py: np.ndarray = py) -> float:
            c = _covers(r, px)
            p, n = int((c & py).sum()), int((c & ~py).sum())
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth, default=[])
        covered = _covers(rule, x) if rule else np.zeros(len(x), bool)
        if not rule or worth(rule) < LEAST_WORTH or not (covered & y).any():
            tries += 1
            continue
        tries = 0
        rules.append(rule)
        x, y = x[~covered], y[~covered]
    return rules


def case_sql(rules: list[list[tuple[int, bool, float]]]) -> str:
    """The rule list as one SQL expression: the number of the first rule that holds, 0 for prose."""
    when = [f"WHEN {' AND '.join(f'{FEATURES[f]} {"<=" if below else ">"} {at:.6f}' for f, below, at in rule)} THEN {k}" for k, rule in enumerate(rules, 1)]
    return f"CASE {' '.join(when)} ELSE 0 END" if when else "0"


_learned: dict[tuple, str] = {}


def learned_sql(common_word: DataFrame, count: int = EXAMPLES, seed: int = SEED) -> tuple[tuple[str, ...], str]:
    """(common words, CASE expression learned with it); kept for the process."""
    common = common_words(common_word)
    listed = common_word.select("lang", "word").filter("word is not null").distinct().limit(2 * MOST_WORDS + 1).collect()
    if len(listed) > 2 * MOST_WORDS:
        raise ValueError(f"more than {2 * MOST_WORDS} common words of languages")
    languages: dict[str, list[str]] = {}
    for lang, word in sorted(map(tuple, listed), key=str):
        languages.setdefault(lang, []).append(word)
    key = (common, tuple((k, tuple(v)) for k, v in languages.items()), count, seed)
    if key not in _learned:
        labelled = examples(languages or {"en": ["the", "of", "and", "to", "in"]}, count, seed)
        spark = common_word.sparkSession
        rows = statistics(spark.createDataFrame(labelled, "text string, bad boolean"), common).select("bad", *FEATURES).toPandas()
        _learned[key] = case_sql(induce(rows[[*FEATURES]].to_numpy(float), rows["bad"].to_numpy(bool), seed))
    return common, _learned[key]


def verdicts(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """doc_id, the statistics and the number of the rule that finds the document not to be prose, or 0."""
    common, rules = learned_sql(common_word)
    stats = statistics(documents.select("doc_id", "text"), common).drop("text")
    return stats.withColumn("rule_no", F.when(F.col("n_words").isNotNull(), F.expr(rules)))


def found(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """doc_id of every document that is for the most part not natural prose."""
    # a filter on the verdict itself would be pushed below the statistics and take a copy of them for every condition
    return verdicts(documents, common_word).groupBy("doc_id").agg(F.max("rule_no").alias("rule_no")).filter("rule_no > 0").select("doc_id")
