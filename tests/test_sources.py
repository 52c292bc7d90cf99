from knotwork.sources import readers, writers
from knotwork.streaming.ingest import Table, ingest, watch

TTL = '''@prefix : <http://x/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .
:a a :Paper ; :title "A \\"quoted\\" one"@en , "two"^^xsd:string ; :year 2019 ; :list ( :b :c ) .
_:n :knows [ :name "x" ] . # comment
'''


def test_turtle_and_ntriples_round_trip(spark, tmp_path):
    (tmp_path / "g.ttl").write_text(TTL)
    t = readers.turtle(spark, str(tmp_path / "g.ttl"))
    rows = {(r.s, r.p, r.o, r.o_kind, r.o_lang) for r in t.collect()}
    assert ("http://x/a", "http://x/title", 'A "quoted" one', "literal", "en") in rows
    assert t.count() == len(rows) == 11
    writers.write_ntriples(t.filter("s_kind = 'uri' and o_kind <> 'bnode'"), str(tmp_path / "out"))
    back = readers.ntriples(spark, str(tmp_path / "out"))
    assert {(r.s, r.p, r.o, r.o_datatype) for r in back.collect()} == {(r.s, r.p, r.o, r.o_datatype) for r in t.filter("s_kind = 'uri' and o_kind <> 'bnode'").collect()}


def test_triple_lines(spark, tmp_path):
    t = spark.createDataFrame([("p1", "a", "calls", "b\tc"), ("p2", "x", "is", "y")], "paper string, s string, p string, o string")
    writers.write_triple_files(t, str(tmp_path / "t"), "paper")
    got = {tuple(r) for r in readers.triple_lines(spark, str(tmp_path / "t" / "*" / "*.txt")).collect()}
    assert got == {("paper=p1", "a", "calls", "bc"), ("paper=p2", "x", "is", "y")}
    (tmp_path / "fig").mkdir()
    (tmp_path / "fig" / "a.txt").write_bytes(":f1 hasCaption a caption caf\xe9\nshort line\n".encode("latin-1"))
    assert [tuple(r)[1:] for r in readers.figure_lines(spark, str(tmp_path / "fig")).collect()] == [(":f1", "hasCaption", "a caption café")]


def test_standoff_labels_and_folders(spark, tmp_path):
    (tmp_path / "1.ann").write_text("T1\tMethod 0 4\tconv\nT2\tTask 9 12\tocr\nR1\tUsed-for Arg1:T1 Arg2:T2\n*\tsameAs T1 T2\n")
    (tmp_path / "2.ann").write_text("")
    entities, relations = readers.standoff(spark, str(tmp_path / "*.ann"))
    assert {(r.id, r.type, r.start, r.end, r.text) for r in entities.collect()} == {("T1", "Method", 0, 4, "conv"), ("T2", "Task", 9, 12, "ocr")}
    assert {(r.rel, r.arg1, r.arg2) for r in relations.collect()} == {("Used-for", "T1", "T2"), ("sameAs", "T1", "T2")}
    (tmp_path / "l.csv").write_text("﻿a,1\nb,2\na,3\n", encoding="utf-8")
    assert {tuple(r) for r in readers.label_map(spark, str(tmp_path / "l.csv")).collect()} == {("a", "3"), ("b", "2")}
    d = tmp_path / "m" / "repo1"
    d.mkdir(parents=True)
    for k, v in {"title": "T", "stars": "1,234", "date": "yesterday", "tags": "None"}.items():
        (d / f"{k}.txt").write_text(v)
    r = readers.metadata_folder(spark, str(tmp_path / "m")).first()
    assert (r.dir_name, r.title, r.stars, r.date, r.tags, r.code) == ("repo1", "T", 1234, None, None, None)


def test_tei(spark, tmp_path):
    (tmp_path / "x.xml").write_text('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>On X</title></titleStmt><idno type="DOI">10.1/x</idno><abstract><p>Short.</p></abstract></teiHeader><text><body><p>One.</p><p>Two.</p><figure><head>Fig 1</head><figDesc>A diagram</figDesc></figure></body></text></TEI>')
    r = readers.tei(spark, str(tmp_path / "x.xml")).first()
    assert (r.title, r.doi, r.abstract, r.text, r.figures[0].caption) == ("On X", "10.1/x", "Short.", "One. Two.", "A diagram")


def test_drawings(spark):
    e = spark.createDataFrame([("a.b", "node")], "src string, dst string")
    assert writers.dot_lines(e).first()[0] == '    "a__b" -> "nodeX";'
    assert [r.value for r in writers.tgf_lines(e).collect()] == ["a.b a.b", "node node", "#", "a.b node"]


def test_ingestion_is_idempotent(spark, tmp_path):
    kind = "dir_name string, framework string, n int, status string"
    rows = spark.createDataFrame([("a", "tf", 1, None), ("a", "tf", 0, None), ("b", "pytorch", 1, None)], kind)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    target = Table(spark, str(tmp_path / "table"), "dir_name")
    work = lambda df: df.selectExpr("dir_name", "'done' as status")
    for check in ("c1", "c2"):  # the second query sees the same files again
        ingest(watch(spark, str(tmp_path / "in"), kind), target, ["n"], str(tmp_path / check), work=work).awaitTermination()
    assert [tuple(r) for r in target.read().select("dir_name", "n", "status").collect()] == [("a", 0, "done")]


def test_tei_parts_stay_with_their_element(spark, tmp_path):
    (tmp_path / "x.xml").write_text(
        '<TEI><teiHeader><titleStmt><title>On <hi>X</hi></title></titleStmt></teiHeader><text><front><author><persName><surname>Solo</surname></persName></author></front><body><div><p>One <ref>two</ref>.</p></div><div><p>Three.</p></div><div><p>Four.</p></div>'
        "<figure><figDesc>no head</figDesc></figure><figure><head>Fig 2</head><figDesc>second</figDesc></figure></body></text></TEI>"
    )
    (tmp_path / "broken.xml").write_text("<TEI><a></TEI>")
    (r,) = readers.tei(spark, str(tmp_path / "*.xml")).collect()
    assert (r.title, r.doi, r.authors, r.text, r.sections) == ("On X", None, ["Solo"], "One two. Three. Four.", ["One two.", "Three."])
    assert [(f.head, f.caption) for f in r.figures] == [(None, "no head"), ("Fig 2", "second")]


def test_labels_with_quotes_and_positions(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeff"k, 1",x,"v ""1"""\nplain,y,2\n\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("plain,z,3\nempty,,\n", encoding="utf-8")
    assert {tuple(r) for r in readers.label_map(spark, str(tmp_path / "*.csv")).collect()} == {("k, 1", 'v "1"'), ("plain", "3"), ("empty", "")}
    assert {tuple(r.fields) for r in readers.positional_csv(spark, str(tmp_path / "b.csv"), skip=0).collect()} == {("plain", "z", "3"), ("empty", "", "")}


def test_nested_owl(spark, tmp_path):
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:o="http://o/">'
    (tmp_path / "a.owl").write_text(head + '<o:Class rdf:about="A"><o:sub><o:Restriction><o:on rdf:resource="P"/></o:Restriction></o:sub><o:all rdf:parseType="Collection"><o:Class rdf:about="B"/><o:Class rdf:about="C"/></o:all></o:Class></rdf:RDF>')
    (tmp_path / "b.owl").write_text("no xml")
    rows = {tuple(r) for r in readers.rdf_xml(spark, str(tmp_path / "*.owl")).collect()}
    inner = next(o for s, p, o, k in rows if p == "http://o/sub")
    assert inner.startswith("_:") and (inner, "http://o/on", "P", "uri") in rows
    assert sum(p.endswith("#first") for _, p, _, _ in rows) == 2 and sum(o.endswith("#nil") for _, _, o, _ in rows) == 1


def test_archives_and_slots(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("r/a.py", "x = 1\n")
        z.writestr("r/b.txt", "no")
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    assert [(r.path, r.code) for r in readers.archives(spark, str(tmp_path)).collect()] == [("r/a.py", "x = 1\n")]
    (tmp_path / "1.pdf").write_bytes(b"two pages")
    (tmp_path / "2.pdf").write_bytes(b"\xff")

    def pages(path, content):
        for k, word in enumerate(content.decode().split()):
            yield k, word

    got = {(r.path.rsplit("/", 1)[-1], r.page, r.text, r.error is None) for r in readers.binary_slot(spark, str(tmp_path), pages, "page int, text string").collect()}
    assert got == {("1.pdf", 0, "two", True), ("1.pdf", 1, "pages", True), ("2.pdf", None, None, False)}


def test_items_that_fail_and_compaction(spark, tmp_path):
    from knotwork.streaming.ingest import attempted, report

    rows = spark.createDataFrame([("a", 1), ("b", 0)], "dir_name string, n int")
    got = {tuple(r) for r in attempted(rows, "dir_name", lambda r: 1 // r["n"], ["n"]).collect()}
    assert {(k, s) for k, s, _ in got} == {("a", "success"), ("b", "error")} and any("ZeroDivisionError" in (m or "") for _, _, m in got)
    target = Table(spark, str(tmp_path / "t"), "dir_name")
    target.insert(rows.selectExpr("*", "cast(null as string) status"), ["n"], 0)
    target.update(spark.createDataFrame([("a", "done")], "dir_name string, status string"), 0)
    before = sorted(map(tuple, target.read().collect()), key=str)
    target.compact()
    assert sorted(map(tuple, target.read().collect()), key=str) == before and spark.read.parquet(target.path).count() == 2
    sent = []
    assert report(target, "status", sent.append) == [("done", 1), (None, 1)] or sent
    assert report(target, "status", None)


def test_numbers_and_places(spark):
    from pyspark.sql import functions as F

    from knotwork.operators import sampling

    df = spark.range(0, 5000, 1, 7).select(F.col("id"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"))
    want = sorted(r.v for r in df.collect())
    assert sampling.nth_smallest(df, F.col("v"), [1, 777, 5000, 5001], width=16) == [want[0], want[776], want[-1], None]
    got = [(r.idx, r.v, r.id) for r in sampling.numbered(df, ["v", "id"]).orderBy("idx").collect()]
    assert got == [(k, v, i) for k, (v, i) in enumerate(sorted((r.v, r.id) for r in df.collect()))]
    assert sampling.numbered(df.limit(0), ["v"]).count() == 0
    v = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(60)] + [(60, None)], "k long, v array<double>")
    near = sampling.most_similar(v, "k", "v", v.filter("k < 2"), 3).collect()
    assert [(r.k, r.rank) for r in sorted(near, key=lambda r: (r.k, r["rank"]))] == [(a, b) for a in (0, 1) for b in (1, 2, 3)]
    assert {r.other for r in near if r.k == 0} == {21, 42, 0} - {0} | {r.other for r in near if r.k == 0 and r["rank"] == 3}


def test_functions_of_text(spark):
    from pyspark.sql import functions as F

    from knotwork.functions import strings as S

    df = spark.createDataFrame([("http://x/Neural_Network_%28NN%29", "http://h/a/b.pdf"), ("bad%zz", None)], "t string, f string")
    rows = df.select(S.topic_label(F.col("t")).alias("topic"), S.file_stem(F.col("f")).alias("stem"), S.longest_common(F.col("t"), F.lit("xx_Network")).alias("n")).collect()
    assert (rows[0].topic.label, rows[0].topic.abbreviation, rows[0].stem, rows[0].n) == ("neural network", "nn", "b", 8)
    assert (rows[1].topic.label, rows[1].topic.abbreviation, rows[1].stem) == ("bad%zz", None, None)
    kept = spark.createDataFrame([(["conv", "convolution", "pool", "po"],), ([],)], "w array<string>").select(S.kept_words(F.col("w")).alias("kept")).collect()
    assert [r.kept for r in kept] == [["conv", "pool"], []]
