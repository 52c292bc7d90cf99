import json
import random

import pytest

from knotwork.operators import packed_values as P


def values(spark, fields):
    rows = list(enumerate(fields, 1))
    df = spark.createDataFrame(rows, "paper_id long, tags string")
    out = {k: [] for k, _ in rows}
    for r in P.found(df).orderBy("paper_id", "pos").collect():
        out[r.paper_id].append(r.tag)
        assert r.pos == len(out[r.paper_id])
    return [out[k] for k, _ in rows]


def test_every_way_of_packing(spark):
    fields = [
        "Code Search;Depth Filling", "A | B/C、D\tE\nF", '"Depth, Pose and Flow", X', "'Yes | No Answering',  Y", "Audio\\/Video Sync,Z", "['A', \"Bird's-Eye\", 'In/Out']", '["A \\"b\\" c", "D"]',
        '{A,"B, C",D}', "[A] [B] [C]", '"So ""Soft"" Labels"/A', "Bird's-Eye Detection;Ranker's Regret", "“Depth, Pose”|A", ";;A;;B;", "A;A",
    ]
    assert values(spark, fields) == [
        ["Code Search", "Depth Filling"], ["A", "B", "C", "D", "E", "F"], ["Depth, Pose and Flow", "X"], ["Yes | No Answering", "Y"], ["Audio/Video Sync", "Z"], ["A", "Bird's-Eye", "In/Out"], ['A "b" c', "D"],
        ["A", "B, C", "D"], ["A", "B", "C"], ['So "Soft" Labels', "A"], ["Bird's-Eye Detection", "Ranker's Regret"], ["Depth, Pose", "A"], ["A", "B"], ["A", "A"],
    ]


def test_nothing_gives_no_row(spark):
    assert values(spark, [None, "", "  ", "None", "N/A", "[]", "{}", "\t\n", ";;"]) == [[]] * 9


def test_empty_table_and_long_field(spark):
    empty = spark.createDataFrame([], "paper_id long, tags string, key string, value string")
    assert P.found(empty).count() == 0
    long = ";".join(f"tag {k}" for k in range(3000))
    assert values(spark, [long])[0] == long.split(";")


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, "A;B"), (1, "A;B"), (None, "C")], "paper_id long, tags string")
    assert sorted(map(tuple, P.found(df).collect())) == [(1, 1, "A"), (1, 2, "B")]


def test_frequencies_decide_between_readings():
    edges = P.lattice("[Zero; One]")
    assert not P.is_plain(edges)
    assert P.best_path(edges, {"zero": 50.0, "one": 40.0}, 100.0) == ["Zero", "One"]
    assert P.best_path(edges, {"zero; one": 60.0}, 100.0) == ["Zero; One"]


def test_expected_counts_sum_to_path_lengths():
    edges = P.lattice("[Zero; One]")
    e = P.expected(edges, {}, 10.0)
    assert e["zero"] == pytest.approx(e["one"])
    assert e["zero"] + e["zero; one"] == pytest.approx(1.0)


def test_round_trip_of_quoted_lists():
    r = random.Random(1)
    for _ in range(300):
        tags = ["".join(r.choice("ab ,;|/'x") for _ in range(r.randint(1, 9))).strip() or "q" for _ in range(r.randint(1, 4))]
        tags = [t.strip("'") or "q" for t in tags]
        freq = {t.lower(): 50.0 for t in tags}
        assert P.best_path(P.lattice(json.dumps(tags)), freq, 200.0) == [t.strip() for t in tags if t.strip()]
