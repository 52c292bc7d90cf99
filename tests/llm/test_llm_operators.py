import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from knotwork.llm import canonical, handwritten, incremental, leakage, packing, quality

# --- problem 3

LISTED = [("masked embedding", "masked embedding"), ("masked embed", "masked embedding"), ("gated activation", "gated activation"), ("gated act fn", "gated activation"), ("dilated dropout", "dilated dropout"), ("drop out (dilated)", "dilated dropout"), ("causal convolution", "causal convolution")]


@pytest.mark.parametrize(
    "text, entry",
    [
        ("Masked Embedding", "masked embedding"), ("msaked embeding layer", "masked embedding"), ("embedding, masked", "masked embedding"), ("MaskedEmbedding2D", "masked embedding"), ("maskedembedding", "masked embedding"), ("our gated actlvati0n x4", "gated activation"),
        ("gated activat.", "gated activation"), ("causal convolut. (k=5)", "causal convolution"), ("dropout", "unmatched"), ("masked dropout layer", "unmatched"), ("masked", "unmatched"), ("3x3", "unmatched"), ("--", "unmatched"), ("word error", "unmatched"), ("masked embedding from news", "unmatched"), ("x" * 5000, "unmatched"),
    ],
)
def test_names(text, entry):
    assert canonical.Index(LISTED).entry(text) == entry


def test_prefix_filter_against_all_pairs():
    index = canonical.Index(LISTED)
    r = random.Random(4)
    for _ in range(400):
        text = r.choice(LISTED)[0]
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(text) + 1)
            text = text[:k] + r.choice("abel ") + text[k + r.randint(0, 1) :]
        words = [canonical.fold(w) for w in canonical.tokens(text)]
        own = canonical.pairs(words)
        met = {k for p in canonical.ordered(own, index.rarity)[: canonical.prefix(len(own))] for k, _ in index.under.get(p, ())}
        for k, s in enumerate(index.sets):
            if own and len(own & s) / len(own | s) >= canonical.SIMILAR:
                assert k in met


def test_entries_of_one_word():
    index = canonical.Index([("Dropout", "Dropout"), ("Softmax", "Softmax"), ("soft max", "Softmax"), ("max pooling", "max pooling")])
    assert [index.entry(x) for x in ("Dropout", "dropuot layer", "softmx", "Soft-Max", "pooling", "our dropout of doom")] == ["Dropout", "Dropout", "Softmax", "Softmax", "unmatched", "unmatched"]


def test_long_lists_are_joined(spark):
    r = random.Random(9)
    texts = [None, " ", "3x3", "x" * 3000]
    for variant, _ in LISTED * 12:
        t = variant
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(t))
            t = t[:k] + r.choice("aeblr ") + t[k + r.randint(0, 1) :]
        texts.append(t)
    ent = spark.createDataFrame(list(enumerate(texts)), "entity_id long, entitytext string")
    std = spark.createDataFrame(LISTED, "variant string, layer_type string")
    assert set(map(tuple, canonical.found(ent, std, 2).collect())) == set(map(tuple, canonical.found(ent, std).collect()))


def test_mentions_table(spark):
    std = spark.createDataFrame(LISTED + [(None, "x"), LISTED[0]], "variant string, layer_type string")
    ent = spark.createDataFrame([(1, "masked embed", "a"), (1, "masked embed", "a"), (2, None, "b"), (3, "  ", "c"), (4, "nothing", None), (None, "gated act fn", None)], "entity_id long, entitytext string, layer_type string")
    assert sorted(map(tuple, canonical.found(ent, std).collect())) == [(1, "masked embedding"), (4, "unmatched")]
    assert [r.layer_type for r in canonical.found(ent, std.limit(0)).collect()] == ["unmatched"] * 2
    assert canonical.found(ent.limit(0), std).count() == 0


# --- problem 4

BASE = ("Zokapita: Compact Rumour Detection with Layered Encoders", "zokapita-compact-rumour-detection-with-layered-encoders", "https://git.example/lab/zokapita-tf")


@pytest.mark.parametrize(
    "row, same",
    [
        (("ZOKAPITA - Compact Rumour  Detection with Layered Encoders (with Code)", None, None), True), (("[v2] Zokapita: Compact Rumour Detction with Layered Enocders", None, None), True),
        (("Compact Rumour Detection with Layered Encoders", "zokapita-compact-rumour-detection-with-layered-encoders-2", None), True), (("Zokapita: Compact Rumour Detection…", None, "git@git.example:lab/zokapita-tf.git"), True),
        (("Zokapita: Compact Rumour Detection with Layered Encoders II", None, BASE[2]), False), (("[Re] Zokapita: Compact Rumour Detection with Layered Encoders", "re-" + BASE[1], BASE[2]), False),
        (("Zokapita: Compact Rumour Detection with Layered Encoders, Part 2", BASE[1] + "-part-2", BASE[2]), False), (("A Critical Comment on Zokapita: Compact Rumour Detection with Layered Encoders", None, None), False),
        (("Bitovelo: Compact Rumour Detection with Layered Encoders", None, BASE[2]), False), ((None, BASE[1] + "-v2", None), True), ((None, None, BASE[2]), False),
    ],
)
def test_same_work(row, same):
    marks = frozenset({"v2", "with code"})
    assert incremental.same_work(BASE, row, marks) is same and incremental.same_work(row, BASE, marks) is same


def papers(spark):
    rows = [(1, 0, *BASE), (2, 0, "Other Things: A Study of Many Models", "other", None), (5, 1, BASE[0].upper(), None, None), (4, 1, "Other Things: A Stdy of Many Models", None, None), (6, 2, BASE[0].replace("Layered", "Layred") + ".", None, BASE[2]), (7, 2, None, None, None), (8, 2, "", "", ""), (9, 2, BASE[0] + " II", None, BASE[2]), (10, 3, BASE[0] + " II.", None, None)]
    rows += [(100 + k, 4, BASE[0], BASE[1], BASE[2]) for k in range(60)]
    return spark.createDataFrame(rows + rows[:2], "paper_id long, batch_no int, title string, stored_dir_name string, code string")


def test_found_equals_incremental_batches(spark, tmp_path):
    df = papers(spark)
    want = {(1, 5), (2, 4), (1, 6), (9, 10), *((1, 100 + k) for k in range(60))}
    got = [tuple(r) for r in incremental.found(df).collect()]
    assert set(got) == want and len(got) == len(want)
    store = incremental.HashStore(spark, str(tmp_path / "store"))
    each = [set(map(tuple, store.check_batch(df.filter(F.col("batch_no") == b)).select("paper_id_a", "paper_id_b").collect())) for b in range(5)]
    assert set().union(*each) == want
    assert incremental.found(df.limit(0)).count() == 0


# --- problem 5


def tool_corpus():
    """Files of tools, every third one under a path that the bundled attribute file knows, and hand-written ones."""
    plain = "import os\n\ndef f(x):\n    # reads the {0} of one batch\n    y = x + 1\n    for i in y:\n        print(i, os)\n    return y\n"
    makers = [
        ("_pb2.py", "# Made by the tree compiler, changes will be lost\nimport os\nx = {0}\n"), (".min.js", "function a(b,c){{if(b>1){{d(b);}}for(var i=0;i<b.length;i++){{e+=b[i]/{0};}}return b;}}" * 3),
        ("_rc.py", "W = np.array([\n" + "    [0.123, -1.5, {0}],\n" * 30 + "])\n"), ("-lock.json", '{{\n' + '"a{0}": "1.2.3",\n' * 9 + '"b": 1}}'),
        ("_pb2.py", "def build(i):\n" + "".join(f"    t{k + 1} = op(t{k}, n={k})\n" for k in range(20)) + "# {0}\n"),
    ]
    rows, made = [], set()
    for k in range(60):
        end, code = makers[k % 5]
        name = f"m{k}{end}" if k % 3 == 0 else f"m{k}{end[-3:] if end[-3] == '.' else '.json'}"
        rows.append((k, f"repo{k % 7}", f"r/src/{name}", code.format(k)))
        made.add(k)
    rows += [(100 + k, f"repo{k % 7}", f"r/src/h{k}.py", plain.format(k)) for k in range(120)]
    rows += [
        (300, "z", "r/a.py", '"""Writes a header that says: made by the tree compiler."""\nimport os\n\ndef f():\n    return 1\n'), (301, "z", "r/e.json", '{"a": [1, 2, 3]}'), (302, "z", "r/h.ipynb", "{}"), (303, "z", "r/__init__.py", "# package\n"),
        (304, "z", "r/f.py", "MEAN = [" + "0.25, " * 60 + "]\n\ndef f(x):\n    y = x + 1\n    for i in y:\n        print(i)\n    return y\n" * 3), (305, "z", "r/g.py", "# line of a licence\n" * 30 + "# Made by the tree compiler, changes will be lost\nx = 1\n"),
        (306, "z", "r/k.py", "# line of a licence\n" * 30 + "x = 1\n# Made by the tree compiler\n"), (307, "z", "r/big-lock.json", "{}"), (308, "z", "r/late.json", '{"a": "' + "x" * 5000 + '",\n' + '"b": "1.2.3",\n' * 40 + '"c": 1}'),
    ]
    return rows, made | {305, 307, 308}


def test_patterns_are_mined_from_declared_files(spark):
    rows, made = tool_corpus()
    df = spark.createDataFrame(rows, "file_id long, stored_dir_name string, code_path string, code string")
    assert {r.file_id for r in handwritten.found(df).collect()} == made
    # nothing declared, nothing mined
    bare = df.filter("file_id >= 300 and file_id not in (307)")
    assert handwritten.found(bare).count() == 0


def test_declared_files_of_repositories_are_mined(spark):
    rows, _ = tool_corpus()
    # no telling path at all: one repository declares its files by an attribute file
    rows = [(k, f"repo{k % 7}", f"r/src/m{k}.{p.rsplit('.', 1)[-1]}", c) if k < 60 else (k, d, p, c) for k, d, p, c in rows if k < 300]
    rows = [(k, d, p.replace("r/src", "r/out") if k < 60 and k % 7 in (2, 3) else p, c) for k, d, p, c in rows]
    rows += [(400 + k, f"repo{k}", "r/.gitattributes", "out/* linguist-generated\n") for k in (2, 3)]
    df = spark.createDataFrame(rows, "file_id long, stored_dir_name string, code_path string, code string")
    assert {r.file_id for r in handwritten.found(df).collect()} == set(range(60))


def test_attribute_globs():
    import re

    hit = lambda g, p: re.match(handwritten.glob_regex(g), p) is not None
    assert hit("*.js", "a/b/c.js") and hit("/a/*.js", "a/c.js") and not hit("/a/*.js", "a/b/c.js") and hit("gen/**", "gen/y/z.py") and not hit("gen/**", "x/gen/y/z.py") and hit("**/gen/**", "x/gen/y/z.py") and hit("a/**/b", "a/b") and not hit("*.js", "a.jsx")
    rules = handwritten.parse_attributes('# c\n*.py linguist-generated -linguist-vendored\nx linguist-generated=false\ny !linguist-generated\n"a b.py" linguist-vendored\n')
    assert [r[1:] for r in rules] == [("generated", True), ("vendored", False), ("generated", False), ("generated", None), ("vendored", True)]
    assert re.match(rules[4][0], "x/a b.py")
    files = (("", "*.py generated\ndocs/* vendored\n"), ("sub/", "*.py !generated\nk.py -generated\n"))
    kinds = {p: handwritten.declared_kind(p, files) for p in ("a.py", "docs/b.py", "sub/c.py", "sub/k.py", "sub/docs/d.js", "e.js")}
    assert kinds == {"a.py": "generated", "docs/b.py": "vendored", "sub/c.py": None, "sub/k.py": "by hand", "sub/docs/d.js": None, "e.js": None}


def test_files_table(spark):
    body = "\n\n".join(f"def function_number_{k}(argument, other):\n    value = argument * {k} + other\n    return value" for k in range(6))
    plain = "def mine(argument, other):\n    value = argument * 77 + other\n    for i in value:\n        print(i)\n    return value\n"
    rows = [
        (1, "a", "r/third_party/x.py", "# Taken from x 1.2.3 without changes\n" + body), (2, "b", "r/util.py", body.replace("\n", "\r\n") + "\n\n" + plain), (3, "b", "r/own.py", plain), (4, "c", "r/.gitattributes", "*.py linguist-generated\n"),
        (5, "c", "r/t.py", plain), (6, "c", "r/sub/.gitattributes", "*.py linguist-generated=false\n"), (7, "c", "r/sub/u.py", plain), (8, "c", "r/e.py", ""), (9, "d", None, None), (3, "b", "r/own.py", plain),
    ]
    df = spark.createDataFrame(rows, "file_id long, stored_dir_name string, code_path string, code string").withColumn("reason", F.lit("x"))
    assert sorted(r.file_id for r in handwritten.found(df).collect()) == [1, 2, 5]
    assert handwritten.found(df.limit(0)).count() == 0


# --- problem 6


def test_sum_of_squares_rule_by_brute_force():
    r = np.random.default_rng(1)
    for capacity in (7, 20):
        sizes = r.integers(1, capacity + 1, 120)
        where, start, count = packing.sum_of_squares(sizes, capacity)
        room = []
        for s, w, b in zip(sizes, where, start, strict=True):
            score = {}
            for g in sorted({x for x in room if x >= s}) + [None]:
                new = list(room)
                if g is None:
                    new.append(capacity - s)
                else:
                    new[new.index(g)] -= s
                n = np.bincount([x for x in new if x > 0], minlength=capacity + 1)
                score[g] = int((n**2).sum())
            least = min(score.values())
            took = None if w == len(room) else room[w]
            assert score[took] == least
            if took is None:
                room.append(capacity)
            assert capacity - room[w] == b
            room[w] -= s
        assert count == len(room) and min(room) >= 0


def test_placements_are_complete(spark):
    docs = spark.createDataFrame([(k, (k * 37) % 90) for k in range(500)] + [(900, 1050), (901, None), (902, -3), (None, 5), (3, 1)], "doc_id long, n_tokens int").withColumn("container_id", F.lit(1))
    spec = spark.createDataFrame([(1, 100), (2, 256), (None, 5), (3, 0)], "spec_id int, capacity_tokens int")
    rows = packing.placements(docs, spec).collect()
    for cap in (100, 256):
        own = [r for r in rows if r.capacity_tokens == cap]
        boxes, parts = {}, {}
        for r in own:
            boxes.setdefault(r.container_id, []).append((r.start_token, r.start_token + r.n_tokens))
            parts.setdefault(r.doc_id, []).append((r.doc_start, r.doc_start + r.n_tokens, r.part_no))
        for b in boxes.values():
            at = 0
            for lo, hi in sorted(x for x in b if x[1] > x[0]):
                assert lo == at
                at = hi
            assert at <= cap
        assert len(parts) == 503 and len(parts[900]) == -(-1050 // cap) and parts[901] == [(0, 0, 0)]
        for p in parts.values():
            at = 0
            for lo, hi, k in sorted(p):
                assert lo == at
                at = hi
    assert {r.filled > 0.97 for r in packing.fill(docs, spec).collect()} == {True}
    assert packing.placements(docs.limit(0), spec).count() == 0 and packing.placements(docs, spec.limit(0)).count() == 0


# --- problem 7


def test_index_against_scan():
    r = np.random.default_rng(3)
    for size, symbols in ((1, 3), (50, 2), (4000, 5), (3000, 40)):
        text = np.r_[r.integers(0, symbols + 1, size), 0].astype(np.int32)
        ix = leakage.FMIndex(text, symbols)
        phrases = r.integers(1, symbols + 1, (60, 3)).astype(np.int32)
        found = {int(k): sorted(ix.locate(np.arange(lo, hi)).tolist()) for k, lo, hi in zip(*ix.search(phrases), strict=True)}
        for k, p in enumerate(phrases):
            assert found.get(k, []) == [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]


def test_leaks(spark):
    r = random.Random(1)
    stock = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
    item = [r.choice(stock) for _ in range(60)]
    other = lambda n: [r.choice(stock) for _ in range(n)]
    noisy = [w for k, w in enumerate(item[10:45]) for w in ([w, "really"] if k % 9 == 8 else [w])]
    texts = {
        1: " ".join(other(30) + item + other(30)), 2: " ".join(other(20) + noisy + other(20)).upper(), 3: " ".join(other(30) + item[5:15] + other(30)), 4: " ".join(other(200)), 5: None, 6: "  ", 7: " ".join(other(3000) + item[:30] + other(3000)), 8: "-\n".join(" ".join(item)[k : k + 41] for k in range(0, 330, 41)),
        9: " ".join(item[:22]) + " " + " ".join(other(18)) + " " + " ".join(item[22:40]),
    }
    docs = spark.createDataFrame([*texts.items(), (1, texts[1])], "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(11, " ".join(item)), (12, None), (13, ""), (14, "one two"), (11, " ".join(item))], "item_id long, text string")
    got = [tuple(x) for x in leakage.found(docs, items).collect()]
    assert sorted(got) == [(1, 11), (2, 11), (7, 11), (8, 11), (9, 11)]
    assert leakage.found(docs.limit(0), items).count() == 0 and leakage.found(docs, items.limit(0)).count() == 0
    spans = {x.doc_id: (x.first_word, x.last_word) for x in leakage.removal_spans(docs.filter("doc_id = 1"), items).collect()}
    assert spans == {1: (30, 89)}


# --- problem 8


def test_quality(spark):
    words = spark.createDataFrame([(lang, k, w) for lang, t in {"en": "the of and to in a is that for it as was with be by on not at are this have from or an which we their", "de": "der die das und in zu den ist mit von auf nicht ein eine als auch es an wir"}.items() for k, w in enumerate(t.split())], "lang string, rank_no int, word string")
    prose = "The model of this paper is not better than the baseline, and we have no reason for it. In the end it was as good as an older one, which is what we said at the start of this study."
    rows = [(1, prose), (2, prose.upper()), (3, None), (4, " \n\t"), (5, "\n".join(f"- item number {k}" for k in range(30))), (6, "a=1;b=2;{x[3]}" * 40), (7, "Please try again later. " * 50), (8, "Name | 1 | 2\n" * 25), (9, "12345 67890"), (10, "Das Modell ist nicht gut und wir haben es auch mit den Daten von der Suche nicht verbessert."), (11, prose + "\n" + "- a list\n- of two"), (1, prose)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(5)).withColumn("lang", F.lit("en"))
    verdicts = {r.doc_id: r for r in quality.verdicts(docs, words).collect()}
    assert verdicts[3].n_words is None and verdicts[4].rule_no is None
    v = verdicts[1]
    assert v.n_words == 40 and v.end_punct_share == 1.0 and v.digit_ratio == 0 and 0.4 < v.common_share < 0.8
    got = {r.doc_id for r in quality.found(docs, words).collect()}
    assert {5, 6, 7, 8} <= got and not got & {1, 2, 3, 4, 10, 11}
    assert quality.found(docs.limit(0), words).count() == 0


def test_rules_on_held_out_examples(spark):
    words = spark.createDataFrame([("en", w) for w in "the of and to in is that for it as was with be by on not at are this have from or an which we their".split()], "lang string, word string")
    common = quality.common_words(words)
    make = lambda seed, n: quality.statistics(spark.createDataFrame(quality.examples({"en": list(common)}, n, seed), "text string, bad boolean"), common).select("bad", *quality.FEATURES).toPandas()
    train, test = make(1, 1500), make(2, 600)
    rules = quality.induce(train[[*quality.FEATURES]].to_numpy(float), train["bad"].to_numpy(bool))
    x = test[[*quality.FEATURES]].to_numpy(float)
    guess = np.zeros(len(x), bool)
    for rule in rules:
        guess |= quality._covers(rule, x)
    assert (guess == test["bad"].to_numpy(bool)).mean() > 0.85
    assert quality.case_sql([]) == "0" and quality.case_sql(rules).startswith("CASE WHEN ")


def test_chance_run_inside_a_long_copy():
    # two long halves of an item around an edit, and a run of three chance words far before the end of the first half
    item = list(range(1, 1501))
    grams = leakage.grams_of(item)
    doc = item[100:485] + [9001, 9002, 9003, 9004, 9005] + item[490:870]
    assert leakage.passage(item, grams, doc)[0] >= 765
    with_chance = doc[:200] + doc[200:388] + doc[388:]
    held = []
    for at in (120, 385, 389, 600):
        doc2 = with_chance[:at] + item[1200:1203] + with_chance[at:]
        held.append(leakage.passage(item, grams, doc2)[0])
    assert min(held) >= 755


def test_passage_against_all_chains():
    r = random.Random(12)
    for _ in range(60):
        item = [r.randint(1, 12) for _ in range(r.randint(3, 60))]
        doc = [r.randint(1, 12) for _ in range(20)] + [x for x in item if r.random() > 0.15] + [r.randint(1, 12) for _ in range(20)]
        grams = leakage.grams_of(item)
        runs = leakage.common_runs(item, grams, doc)
        best = leakage.best_chain(runs)
        assert best[0] == pytest.approx(max((x[0] for x in leakage.chains_one_by_one(runs)), default=0.0))


def test_hot_phrase_of_all_items(spark):
    stock = "it is not allowed to give any answer before all of the question has been read"
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(k, stock + " " + " ".join(word() for _ in range(60))) for k in range(150)]
    docs = [(k, " ".join([*(word() for _ in range(30)), stock, *(word() for _ in range(30))])) for k in range(300)] + [(1000 + k, "x " + items[k][1]) for k in range(20)]
    got = leakage.found(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {tuple(x) for x in got} == {(1000 + k, k) for k in range(20)}


def test_leaks_of_a_repeated_passage(spark):
    item = "the seven grey herons of the lower marsh were counted again by two wardens who had never agreed on any number before"
    rest = " ".join(f"word{k}" for k in range(600))
    docs = spark.createDataFrame([(1, f"{rest} {item} some more {item} {rest} {item}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    n = len(item.split())
    spans = sorted((x.first_word, x.last_word) for x in leakage.removal_spans(docs, items).collect())
    assert spans == [(600, 599 + n), (602 + n, 601 + 2 * n), (1202 + 2 * n, 1201 + 3 * n)]
    assert leakage.found(docs, items).count() == 1


def test_paragraphs_of_cut_and_glued_titles(spark):
    long = "a deep network for the robust segmentation of medical images with very few labelled examples in practice"
    cut = "a deep netwrok for the robust segmentation of medical images with very few labelled..."
    glued = "a deepnetwork forthe robustsegmentation ofmedical imageswith veryfew labelledexamples inpractice everywhere"
    rows = [(1, long, None, None, 0), (2, cut, None, None, 1), (3, long + " everywhere", None, None, 2), (4, glued, None, None, 3)]
    paper = spark.createDataFrame(rows, "paper_id long, title string, stored_dir_name string, code string, batch_no int")
    assert set(map(tuple, incremental.found(paper).collect())) == {(1, 2), (3, 4)}


def test_later_row_joins_no_accepted_works(spark, tmp_path):
    # row 3 has the title of one accepted work and the directory of another; both stay accepted
    rows = [(1, 0, "one long title of the first work", "first-dir", None), (2, 0, "quite another title of a second work", "second-dir", None), (3, 1, "one long title of the first work", "second-dir", None), (4, 1, "Quite another title of a second work", None, None)]
    paper = spark.createDataFrame(rows, "paper_id long, batch_no int, title string, stored_dir_name string, code string")
    want = {(1, 3), (2, 4)}
    assert set(map(tuple, incremental.found(paper).collect())) == want
    # any grouping of rows into batches gives the same, and a batch given twice is not counted twice
    store = incremental.HashStore(spark, str(tmp_path / "store"), 4)
    for ids in ((1,), (2, 3), (2, 3), (4,)):
        store.check_batch(paper.filter(F.col("paper_id").isin(*ids)))
    assert set(map(tuple, store.verdicts().collect())) == want
    # an attempt without its marker does not count
    again = incremental.HashStore(spark, str(tmp_path / "store"), 4)
    assert set(map(tuple, again.verdicts().collect())) == want and len(again.done) == 4
    again.done = again.done[:1]
    assert again.verdicts().count() == 0


def test_hot_work_and_batches_of_any_cut(spark, tmp_path):
    r = random.Random(5)
    rows = []
    for k in range(120):
        t = list("Zokapita: Compact Rumour Detection with Layered Encoders for Long Inputs")
        if k:
            at = r.choice([j for j in range(12, len(t) - 1) if t[j] != " "])
            t[at] = "q"
        rows.append((k, k // 60, "".join(t), None, None))
    rows += [(1000 + k, 1, f"{chr(97 + k) * 6}: Compact Rumour Detection with Layered Encoders for Long Inputs", None, None) for k in range(20)]
    paper = spark.createDataFrame(rows, "paper_id long, batch_no int, title string, stored_dir_name string, code string")
    got = set(map(tuple, incremental.found(paper).collect()))
    assert got == {(0, k) for k in range(1, 120)}


def test_learned_marks(spark):
    rows = []
    for k in range(6):
        t, d = f"Model{k}: A Study of Thing {'abcdef'[k]} in Depth", f"model{k}-a-study-of-thing-{'abcdef'[k]}-in-depth"
        rows += [(t, d), (f"{t} (with code)", d), (f"[Re] {t}", "re-" + d), (f"{t}, part 2", d + "-part-2")]
    paper = spark.createDataFrame(rows, "title string, stored_dir_name string")
    assert incremental.learned_marks(paper) == {"with code"}
    assert incremental.learned_marks(paper.limit(0)) == frozenset()
