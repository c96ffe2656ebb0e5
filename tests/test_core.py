"""Scalar functions, catalog operators, key-value tables, graphs, sources and sinks on small inputs."""

import json
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import ids, paths, text
from ledgerloom.operators import catalog, features, feedback, graph, kv, validation
from ledgerloom.sources import readers, writers


def col(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(expr).collect()]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_suffixes(spark):
    assert col(spark, paths.suffix(F.col("v")), "a.tar.gz", ".bashrc", "x", "a.", None) == [".gz", "", "", "", None]
    assert col(spark, paths.double_suffix(F.col("v")), "a.tar.gz", "b.js", "x.min.js.map") == [".tar.gz", "", ".js.map"]
    assert col(spark, paths.tokens(F.col("v")), "IMG_2024-report FinalV2.pdf", "") == [["img", "2024", "report", "final"], []]
    assert col(spark, paths.clean_folder(F.col("v")), 'a<b>:  c"', None) == ["ab c", None]


@pytest.mark.parametrize("name", ["acme", "é tudes", ""])
def test_uuid5_is_pythons(spark, name):
    assert col(spark, ids.uuid5(ids.NAMESPACES["company"], F.col("v")), name) == [str(uuid.uuid5(ids.NAMESPACES["company"], name))]


def test_iri(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    assert col(spark, ids.to_iri(F.col("v")), "urn:x", u.upper(), "a" * 64, "https://a.b") == ["urn:x", f"urn:uuid:{u}", "urn:sha256:" + "a" * 64, "https://a.b"]


def test_texts(spark):
    assert col(spark, text.count_of(F.col("v"), "aa"), "aaaa", "b", None) == [2, 0, None]
    assert col(spark, text.iso_duration(F.col("v").cast("double")), "3661", "0", "59.9", "7200") == ["PT1H1M1S", "PT0S", "PT59S", "PT2H"]
    assert col(spark, text.duration_text(F.col("v").cast("double")), "5", "90", "7200") == ["5.0s", "1.5 min", "2.0 h"]
    assert col(spark, text.html_escaped(F.col("v")), "<a&'\">") == ["&lt;a&amp;&#x27;&quot;&gt;"]


def test_latest_and_upsert(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, None, "c"), (2, 1, "d")], "id int, at int, v string")
    assert rows(catalog.latest(df, ["id"], ["at"])) == [(1, 7, "b"), (2, 1, "d")]
    base = spark.createDataFrame([(1, "x", "k"), (2, "y", None)], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "z", "m")], "id int, v string, w string")
    assert sorted(map(str, rows(catalog.upsert(base, new, ["id"], ["w"])))) == sorted(map(str, [(1, "x", "k"), (2, None, "n"), (3, "z", "m")]))
    assert rows(catalog.upsert(base.where("false"), new, ["id"]).select("id")) == [(2,), (3,)]


def test_near_join_finds_all_close_pairs(spark):
    import random

    rnd = random.Random(8)
    pts = [(i, rnd.uniform(-0.01, 0.01), rnd.uniform(-0.01, 0.01)) for i in range(120)]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {(r.id_a, r.id_b) for r in catalog.near_join(df, df).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if abs(a[1] - b[1]) < 0.001 and abs(a[2] - b[2]) < 0.001}


def test_nearest_entry_of_a_whole_gazetteer(spark):
    """More than twenty entries, equal points, equal distances and points without an entry."""
    import random

    rnd = random.Random(9)
    spot = lambda: (rnd.randrange(-40, 40) / 4, rnd.randrange(-40, 40) / 4)
    gaz = [(i, f"g{i:03}", *spot()) for i in range(60)]
    pts = [(i, *(spot() if i % 3 else gaz[i % 60][2:])) for i in range(150)] + [(150, 80.0, 80.0)]
    far = lambda p, g: abs(p[1] - g[2]) + abs(p[2] - g[3])
    want = {(p[0], min((far(p, g), g[1]) for g in near)[1]) for p in pts if (near := [g for g in gaz if abs(p[1] - g[2]) < 3 and abs(p[2] - g[3]) < 3])}
    got = catalog.nearest_entry(spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(gaz, "id int, name string, lat double, lon double"), 3.0)
    assert set(rows(got)) == want and got.count() == len(want) < len(pts)


def test_paging_and_names(spark):
    df = spark.createDataFrame([(i, "f", "a.txt" if i < 3 else f"b{i}") for i in range(9)], "id int, folder string, name string")
    assert [r.id for r in catalog.page(df, [F.desc("id")], 2, 4).collect()] == [4, 3, 2, 1]
    assert [r.n for r in catalog.numbered_names(spark, df, "folder", "name", [F.col("id")], "n").orderBy("id").limit(4).collect()] == ["a.txt", "a_1.txt", "a_2.txt", "b3"]
    extra = spark.createDataFrame([(1, "g", "new"), (50, "g", "b5"), (51, "g", "new"), (52, "g", "new")], "id int, folder string, name string")
    assert rows(catalog.add_missing(df, extra, ["id", "name"], [F.col("id")]).where("id >= 50").select("id")) == [(51,)]


def test_kv(spark):
    log = spark.createDataFrame([("n", "a", 1, "x", None), ("n", "a", 2, "y", datetime(2024, 1, 1)), ("n", "h:f", 1, "1", None), ("n", "h:g", 1, "2", datetime(2024, 1, 1))], "namespace string, key string, seq int, value string, expires_at timestamp_ntz")
    t, now = kv.last_write(log, ["seq"]), F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    assert rows(kv.get(t, "n", ["a", "h:f"], now).select("key", "value")) == [("h:f", "1")]
    assert kv.hash_fields(t, now).first().fields == {"f": "1", "g": None}
    assert rows(t.select("key", kv.remaining(now).alias("t"))) == [("a", 0), ("h:f", -1), ("h:g", 0)]
    assert col(spark, kv.kind(F.col("v")), "true", "12", "1.5", "[1]", "x") == ["bool", "int", "float", "json", "string"]


def test_bfs(spark):
    e = spark.createDataFrame([(1, 1, 2, "A", 0.5), (2, 3, 2, "B", 0.7), (3, 3, 4, "A", 0.1), (4, 4, 5, "A", 0.1), (5, 1, 3, "A", 0.2)], "edge bigint, source bigint, target bigint, type string, confidence double")
    got = rows(graph.breadth_first(spark, e, spark.createDataFrame([(1,)], "id bigint"), 2).selectExpr("id", "hop", "coalesce(via, 0)"))
    assert got == [(1, 0, 0), (2, 1, 1), (3, 1, 1), (4, 2, 3)]


def test_scores_and_split(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "actual string, predicted string")
    assert {r["class"]: (r.support, r.precision, r.recall, r.f1) for r in features.scores(pairs).collect()} == {"a": (2, 0.5, 0.5, 0.5), "b": (1, 0.5, 1.0, 0.6667), "c": (1, 0.0, 0.0, 0.0)}
    df = spark.createDataFrame([(i, "s" if i % 3 else None) for i in range(30)], "id int, s string")
    parts = features.stratified_split(spark, df, "s", "id", 0.2, 1)
    assert rows(parts.groupBy("s", "part").count().selectExpr("coalesce(s, '')", "part", "count")) == [("", "test", 2), ("", "train", 8), ("s", "test", 4), ("s", "train", 16)]
    v = features.vocabulary(spark, spark.createDataFrame([(t,) for t in "b b a a c".split()], "token string"), 2)
    assert rows(v.select("index", "token")) == [(0, "<PAD>"), (1, "<UNK>"), (2, "a"), (3, "b")]


def test_feedback(spark):
    log = spark.createDataFrame([("h1", 1, "x", ["p"]), ("h1", 2, "y", ["p", "q"]), ("h2", 1, "y", ["p"])], "hash string, at int, category string, patterns array<string>")
    assert rows(feedback.current_corrections(log).select("hash", "category")) == [("h1", "y"), ("h2", "y")]
    votes = feedback.pattern_votes(log)
    assert rows(feedback.rules(votes, 3, 0.6)) == [("p", "y", 3, 0.6667)]
    asked = spark.createDataFrame([(1, "x", ["p", "q"]), (2, "y", ["p"]), (3, "x", [])], "id int, category string, patterns array<string>")
    assert rows(feedback.suggestions(asked, votes, 0.6)) == [(1, "x", "y", 0.75)]


def test_validation(spark):
    df = spark.createDataFrame([("a", "a@b.c"), (None, "bad"), ("", None)], "name string, mail string")
    v = validation.validated(df, [*validation.required(["name"]), *validation.formatted({"mail": "@"}), *validation.recommended(["mail"])])
    assert [(r.errors, r.is_valid, len(r.messages)) for r in v.collect()] == [(0, True, 0), (2, False, 2), (1, False, 2)]
    s = validation.summary(v).first()
    assert (s.total, s.valid, s.errors) == (3, 1, 3)


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/a.PNG").write_bytes(b"1")
    (tmp_path / "in/sub/b.txt").write_bytes("é\xff".encode("latin-1"))
    report = {"total_files": 2, "results": [{"source": "/x/a", "status": "organized", "people_names": ["Ann"]}, {"source": "/x/b"}]}
    (tmp_path / "in/content_report.json").write_text(json.dumps(report, indent=1))
    (tmp_path / "in/cost.json").write_text(json.dumps({"features": {"ocr": {"invocations": 3, "cost": 0.5}}}))
    (tmp_path / "c.vcf").write_text("BEGIN:VCARD\r\nVERSION:3.0\r\nFN:Ann\r\n Lee\r\nEMAIL;TYPE=work:a@b.c\r\nEND:VCARD\r\n")
    found = readers.listing(spark, str(tmp_path / "in"))
    assert rows(found.select("filename")) == [("a.PNG",), ("b.txt",), ("content_report.json",), ("cost.json",)]
    assert rows(readers.images(found).select("filename")) == [("a.PNG",)]
    assert rows(readers.routed(found).select("filename", "kind")) == [("content_report.json", "organization"), ("cost.json", "cost")]
    assert readers.latest_report(found, ["cost", "content"]).first().filename == "cost.json"
    r = readers.report(spark, str(tmp_path / "in/content_report.json"))
    assert rows(r.selectExpr("source", "coalesce(status, '-')")) == [("/x/a", "organized"), ("/x/b", "-")]
    assert rows(readers.usage(spark, str(tmp_path / "in/cost.json")).select("feature", "invocations")) == [("ocr", 3)]
    assert rows(readers.contacts(spark, str(tmp_path / "c.vcf")).select("property", "value")) == [("EMAIL", "a@b.c"), ("FN", "AnnLee")]
    writers.quoted_csv(r.select("source"), str(tmp_path / "csv"))
    assert rows(spark.read.csv(str(tmp_path / "csv"), header=True)) == [("/x/a",), ("/x/b",)]
    writers.json_report(r, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    docs = spark.createDataFrame([(i, '{"n":%d}' % i) for i in range(3)], "k int, j string")
    assert json.loads(writers.bundle(docs, "k", "j").first().json)["@graph"] == [{"n": 0}, {"n": 1}, {"n": 2}]
    plan = writers.move_plan(spark.createDataFrame([("in/x/a", "a"), ("in/y/a", "a"), ("out/b", "b")], "path string, filename string"), F.lit("out"))
    assert rows(plan) == [("in/x/a", "out/a", "would_move"), ("in/y/a", "out/a_1", "would_move"), ("out/b", "out/b", "already_organized")]


def test_streams_through_foreach_batch(spark, tmp_path):
    from ledgerloom.streaming import events

    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 1), "a", 2.0), (1, datetime(2024, 1, 1, 1), "a", 2.0), (2, datetime(2024, 1, 2), "b", 1.0)], "event_id bigint, ts timestamp_ntz, event_type string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "s"))
    s = events.event_stream(spark, str(tmp_path / "s"), df.schema)
    assert events.drained(spark, events.first_deliveries(s)).count() == 2
    seen = []
    events.into_table(s, lambda batch, i: seen.append(batch.count()), str(tmp_path / "c")).awaitTermination()
    assert seen == [3]


def test_the_llm_package_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['ledgerloom.llm'] = None\nimport __spark_entry__ as e\nassert 'p1_found' in e.queries() and 'p3_found' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


@pytest.mark.parametrize(
    "name, words",
    [
        ("PDFFile.txt", ["pdf", "file"]), ("café_menü.pdf", ["cafe", "menu"]), ("отчёт_2024.pdf", ["отчёт", "2024"]), ("IMG_20240131-Final V2.tar.gz", ["img", "20240131", "final", "tar"]), ("ABCdef12", ["ab", "cdef", "12"]),
        ("", []), (".bashrc", ["bashrc"]), ("X", []), ("ﬁle_ÄRGER.x", ["file", "rger"]), ("a" * 3000 + ".b", ["a" * 3000]),
    ],
)
def test_words_of_file_names(spark, name, words):
    import unicodedata

    got = col(spark, paths.tokens(F.col("v")), name)[0]
    assert got == [unicodedata.normalize("NFKD", w) for w in words]


def test_numbers_pass_over_names_that_are_there(spark):
    names = ["a.txt", "a.txt", "a_1.txt", "a.txt", "a_3.txt", "a_1.txt", "b", "b", "b_1", "c.x", "C.x", "n\nl.t", "n\nl.t"]
    df = spark.createDataFrame([(i, f, n) for f in ("f", None) for i, n in enumerate(names)], "id int, folder string, name string")
    out = catalog.numbered_names(spark, df, "folder", "name", [F.col("id")], "new").collect()
    assert len({(r.folder, r.new) for r in out}) == len(out) == 2 * len(names)
    one = {r.id: r.new for r in out if r.folder == "f"}
    assert [one[i] for i in range(9)] == ["a.txt", "a_2.txt", "a_1.txt", "a_4.txt", "a_3.txt", "a_1_1.txt", "b", "b_2", "b_1"]
    assert catalog.numbered_names(spark, df.where("false"), "folder", "name", [F.col("id")], "new").count() == 0


def test_latest_takes_one_row_and_few_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("a", 1, "x", "p"), ("a", 2, "y", None), ("a", None, "z", "q"), ("b", None, None, None)], "id string, at int, v string, w string").write.parquet(path)
    rows_ = catalog.latest(spark.read.parquet(path), ["id"], ["at"], total=False)
    assert rows(rows_.select("id", "v").fillna("")) == [("a", "y"), ("b", "")]
    plan = rows_.where("id = 'a'").select("id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "w#" not in plan and "EqualTo(id,a)" in plan
    assert rows(catalog.latest(spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "id string, at int, v string"), ["id"], ["at"])) == [("a", 1, "y")]


def test_names_in_texts(spark):
    from ledgerloom.plans.scalars import company_names, people_names

    t = "From: Ann Bee\nDr. Cid Dow met Eve Fox, PhD. Prepared by:  Ann   Bee. Gus Hay Resume. Zeta  Works Inc. and ZETA WORKS LLC. Ira Joy <i.joy@kite.example>"
    assert sorted(col(spark, people_names(F.col("v")), t)[0]) == ["Ann Bee", "Cid Dow", "Eve Fox", "Gus Hay", "Ira Joy"]
    assert [x.lower() for x in col(spark, company_names(F.col("v")), "Zeta  Works Inc, and ZETA WORKS LLC")[0]] == ["zeta works"] and col(spark, company_names(F.col("v")), None, "") == [None, []]


def test_documents(spark):
    from ledgerloom.functions import jsonld

    doc = {"@type": "Article", "name": "a<b", "url": "http://x", "author": {"@type": "Person", "name": "p"}, "tags": ["q", {"@type": "Thing", "name": "r"}], "image": "i"}
    m, r = (col(spark, f(F.col("v")), json.dumps(doc), "no", None, "[1]") for f in (jsonld.microdata, jsonld.rdfa))
    assert m[1:] == r[1:] == [None, None, None]
    assert m[0].count("itemscope") == 3 and 'href="http://x"' in m[0] and "a&lt;b" in m[0] and '<link itemprop="image" href="i">' in m[0]
    assert r[0].count("typeof=") == 3 and '<div property="author">' in r[0]
    new = col(spark, jsonld.regenerated(F.col("v"), F.lit('{"keep":{"n":[1,2]},"name":"old"}'), ["keep"]), '{"name":"new"}')[0]
    assert json.loads(new) == {"name": "new", "keep": {"n": [1, 2]}}
    assert col(spark, jsonld.graph(F.array("v")), "{}") == ["{}"]


def test_problems_of_documents(spark):
    found = lambda d: set(validation.problems(d))
    good = {"@context": "c", "@type": "Dataset", "name": "n", "description": "d", "creator": "x", "distribution": "y"}
    assert found(good) == {("success", "type", None)}
    assert ("error", "context", "@context") in found({}) and ("error", "type", "@type") in found({})
    assert ("warning", "nested", "creator") in found(good | {"creator": [{"@type": "Dataset"}]}) and ("warning", "nested", "a") not in found(good | {"a": good})
    deep = good
    for _ in range(50):
        deep = good | {"part": deep}
    assert found(deep) == {("success", "type", None)}
    assert {("error", "url", "url"), ("warning", "date", "dateCreated"), ("error", "value type", "width"), ("warning", "duration", "duration")} <= found(good | {"url": "x", "dateCreated": "1.1.", "width": "5", "duration": "5 min"})
    got = validation.report(spark.createDataFrame([("x",), (None,), (json.dumps(good),)], "j string"), F.col("j")).orderBy("errors").collect()
    assert [r.errors for r in got] == [0, 1, 1] and [r.is_valid for r in got] == [True, False, False]


def test_hashes_in_the_key_value_table(spark):
    t = spark.createDataFrame([("n", "h:a", "1", None), ("n", "h:b", "2", datetime(2020, 1, 1)), ("m", "h:a", "3", None)], "namespace string, key string, value string, expires_at timestamp_ntz")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert rows(kv.fields(t, "n", "h", now)) == [("a", "1")]
    assert rows(kv.fields(kv.expire(t, "n", ["h:b"], None), "n", "h", now)) == [("a", "1"), ("b", "2")]
    assert rows(kv.set_fields(t, "n", "h", spark.createDataFrame([("a", "9")], "field string, value string")).select("namespace", "key", "value")) == [("m", "h:a", "3"), ("n", "h:a", "9"), ("n", "h:b", "2")]
    assert kv.flush(t).count() == 0 and kv.flush(t, "n").count() == 1 and kv.delete(t, "n", ["h:a"]).count() == 2
