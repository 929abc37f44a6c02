"""Chunking, salvage, validation, retries, resume, shapefile round trip and small operators."""

import json

import pytest
from pyspark.sql import functions as F

from zoneweave.functions import geometry as g
from zoneweave.functions import text as tx
from zoneweave.operators import chunks, evaluate, parcels, retrieval, rules
from zoneweave.sources import files, shapefile
from zoneweave.streaming import resume

LAW = """서문은 버려진다
제1조(목적) 이 법은 건축물의 대지에 관한 사항을 정함을 목적으로 한다.
제2조 삭제 <1999. 4. 30.>
제3조(차례)
# 제4조의2(높이) ① 높이는 10미터 이하로 하며 그 밖의 경우에는 따로 정하는 바에 따른다.

법제처 3 국가법령정보센터

부칙 <2001>
이 법은 공포한 날부터 시행한다.
제5조(기타) 1. 그 밖에 필요한 사항은 조례로 정하고 이를 공고하여야 한다.
"""


def test_article_chunks(spark):
    df = spark.createDataFrame([("law.md", LAW), ("x 별표 3 표.md", "표 내용"), ("plain.md", "no heading here"), ("none.md", None), ("blank.md", " \n ")], "source string, text string")
    got = {(r.source, r.article_id, r.section_type, r.article_title) for r in chunks.article_chunks(df).collect()}
    assert got == {("law.md", "제1조", "article", "목적"), ("law.md", "제4조의2", "article", "높이"), ("law.md", "제5조", "article", "기타"), ("x 별표 3 표.md", "별표 3", "appendix", ""), ("plain.md", "", "unknown", "")}


def test_close_headings_count_from_the_last_kept():
    # three matches five characters apart: the third is far from the first, which was kept
    text = "부칙 <\n부칙 <\n부칙 <\n"
    assert [h[0] for h in chunks.headings(text)] == [0, 10]


def test_sliding(spark):
    df = spark.createDataFrame([(1, "x" * 900), (2, "x" * 901), (3, ""), (4, None)], "id long, text string")
    got = [(r.id, r.pos, len(r.chunk)) for r in chunks.sliding_chunks(df, "id").orderBy("id", "pos").collect()]
    assert got == [(1, 0, 900), (2, 0, 900), (2, 1, 121)]


SALVAGE = ['[{"a": 1}]', '{"b": 2}', 'text ```json\n{"c": 3}\n``` end', 'so [1, 2] it is', 'yes {"d": {"e": 1}} no', "[1, 2", "", "plain"]


def test_salvage(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SALVAGE)] + [(99, None)], "id int, t string")
    got = [r.j for r in df.orderBy("id").select(rules.salvage(F.col("t")).alias("j")).collect()]
    assert got == ['[{"a": 1}]', '{"b": 2}', '{"c": 3}', "[1, 2]", '{"d": {"e": 1}}', None, None, None, None]


def test_validate(spark):
    a = {"article_id": "1", "R": {}, "S": {}}
    both = {**a, "list": [{**a, "article_id": "2"}]}
    docs = [json.dumps(x) for x in ([a, {"R": 1}, 3], {"articles": [a]}, {"x": [], "y": [a]}, a, both, {"z": 1})] + ["broken", None]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, json string")
    got = [(r.id, r.article_id) for r in rules.validate(df, "id").orderBy("id").collect()]
    assert got == [(0, "1"), (1, "1"), (2, "1"), (3, "1"), (4, "2")]
    assert [(r.id, r.article_id) for r in rules.validate(df, "id", single_first=True).where("id = 4").collect()] == [(4, "1")]


def test_retries():
    calls = []

    def client(text):
        calls.append(text)
        if len(calls) < 3:
            raise rules.RateLimit("429")
        return "ok"

    waits = []
    assert rules.with_retries(client, "p", sleep=waits.append) == "ok" and waits == [10, 20]

    def never(text):
        raise rules.RateLimit("429")

    with pytest.raises(RuntimeError):
        rules.with_retries(never, "p", sleep=waits.append)
    assert "RateLimit" in rules.with_retries(never, "p", sleep=waits.append, fail=False)


def test_structure_skips_what_is_done(spark):
    df = spark.createDataFrame([("q1", "p"), ("q2", "p")], "label string, prompt string")
    done = spark.createDataFrame([("q1",)], "label string")
    got = rules.structure(df, "label", done).collect()
    assert [(r.label, r.attempts, r.valid) for r in got] == [("q2", 1, True)]
    failed = rules.structure(df, "label", client=lambda t: "none").collect()
    assert sorted((r.label, r.attempts, r.valid, r.raw) for r in failed) == [("q1", 3, False, "none"), ("q2", 3, False, "none")]


def test_latest_and_prompt(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in rules.latest(df, "k", "at").collect()) == [("a", "y"), ("b", "z")]
    ctx = spark.createDataFrame([(1, 2, "s" * 99, "t2"), (1, 1, "s1", "t1")], "item_id int, rank int, source string, text string")
    assert rules.context_text(ctx, "item_id").first().context == "--- [rank 1] s1 ---\nt1\n\n--- [rank 2] " + "s" * 60 + " ---\nt2"


def test_signals_and_slug(spark):
    df = spark.createDataFrame([("제 86 조의 일조 높이 제한과 제86조?",)], "q string")
    assert df.select(tx.signals(F.col("q")).alias("s")).first().s == ["제86조", "일조"]  # '높이 제한' is not '높이제한'
    assert df.select(tx.slug(F.col("q")).alias("s")).first().s == "제-86-조의-일조-높이-제한과-제86조"


def test_parcel_rules(spark):
    df = spark.createDataFrame([("도로", " 13.0 "), (None, None), ("", "99"), ("대", "17")], "jimok string, landuse_raw string")
    got = [(r.kind, r.landuse_code, r.landuse) for r in parcels.classify(df).collect()]
    assert got == [("road", "13", "제1종일반주거지역"), ("road", "", "미확인"), ("road", "99", "미확인"), ("lot", "17", "일반주거지역")]


def test_mrr_takes_the_first_found_token(spark):
    q = spark.createDataFrame([(1, ["absent", "late", "early"], False)], "item_id long, required_items array<string>, gold_ready boolean")
    r = spark.createDataFrame([(1, 1, "ear ly", "s"), (1, 2, "none", "s"), (1, 3, "late", "s")], "item_id long, rank int, text string, source string")
    m = evaluate.question_metrics(q, r).first()
    assert (round(m.recall, 4), round(m.precision, 4), round(m.mrr, 4), m.ready, m.right) == (0.6667, 0.6667, 0.3333, False, 1)


def test_retrieve_modes(spark):
    c = spark.createDataFrame([(1, "a", "red apple pie"), (2, "b", "green apple tart"), (3, "c", "제86조 일조")], "chunk_id long, source string, text string")
    q = spark.createDataFrame([(1, "red apple"), (2, "제 86 조"), (3, "zzz yyy")], "item_id long, question string")
    index = retrieval.Index(c)
    for mode in ("tfidf", "bm25", "dense", "hybrid", "hybrid_bm25_dense", "hybrid_tfidf_dense"):
        got = {r.item_id: r.chunk_id for r in retrieval.retrieve(index, q, 1, mode).collect()}
        assert got[1] == 1 and got[2] == 3 and 3 not in got
    with pytest.raises(ValueError):
        retrieval.retrieve(index, q, 1, "other")


def test_resume(spark, tmp_path):
    seen = []

    def step(d):
        seen.append(d)
        if d == "bad":
            raise ValueError("x")

    path = str(tmp_path / "manifest")
    assert resume.run_districts(spark, ["a", "bad", "c"], step, path)["bad"].startswith("failed")
    assert resume.run_districts(spark, ["a", "bad", "c"], step, path)["a"] == "skipped"
    assert seen == ["a", "bad", "c", "bad"]
    log = str(tmp_path / "log")
    resume.run_districts(spark, ["bad", "d"], step, path, log)
    assert [r.line for r in resume.read_log(spark, log).collect()] == ["bad: failed: ValueError: x", "d: done"]


def test_ingest(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("src", "dst", "ck"))
    spark.range(3).write.parquet(src)
    resume.ingest_new_files(spark, src, "id long", dst, ck)
    spark.range(5, 7).write.mode("append").parquet(src)
    resume.ingest_new_files(spark, src, "id long", dst, ck)
    assert sorted(r.id for r in spark.read.parquet(dst).collect()) == [0, 1, 2, 5, 6]


def test_shapefile_round_trip(spark, tmp_path):
    sq = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    fields = (("A1", "C", 19, 0), ("A11", "C", 8, 0), ("A13", "C", 4, 0))
    shp, shx, dbf = shapefile.pack_features([{"ring": sq, "A1": "p1", "A11": "대", "A13": "13.0"}, {"ring": sq, "A1": "p2", "A11": "", "A13": None}], fields)
    for ext, data in (("shp", shp), ("shx", shx), ("dbf", dbf)):
        (tmp_path / f"Gangnam.{ext}").write_bytes(data)
    df = shapefile.parcels_from_shapes(shapefile.read_shapefiles(spark, str(tmp_path)))
    got = sorted((r.pnu, r.jimok, r.landuse_raw, r.a) for r in df.select("*", g.area(F.col("ring")).alias("a")).collect())
    assert got == [("p1", "대", "13.0", 16.0), ("p2", "", "", 16.0)]
    assert shapefile.first_shapefile(spark, str(tmp_path)).endswith("Gangnam.shp")
    kr = dbf.replace("대".encode(), "대".encode("cp949") + b" ")
    assert shapefile.read_dbf(kr)[1][0]["A11"] == "대"


def test_shapefiles_of_one_stem_in_two_folders(spark, tmp_path):
    sq = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    for folder, n in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        files = shapefile.pack_features([{"ring": sq, "A1": f"{folder}{i}"} for i in range(n)], (("A1", "C", 19, 0),), "cp949")
        for ext, data in zip(("shp", "shx", "dbf"), files, strict=True):
            (tmp_path / folder / f"same.{ext}").write_bytes(data)
    got = shapefile.read_shapefiles(spark, str(tmp_path), ("cp949", "utf-8")).collect()
    assert sorted(r.attributes["A1"] for r in got) == ["a0", "b0", "b1"]
    checks = {r.path[-6:]: r for r in shapefile.verify(shapefile.companions(spark, str(tmp_path))).collect()}
    assert all(r.ok and r.has_shx and not r.korean_grid and "pnu" in r.missing and r.bad_rings == 0 for r in checks.values()) and len(checks) == 2
    (tmp_path / "b" / "same.dbf").write_bytes((tmp_path / "a" / "same.dbf").read_bytes())
    with pytest.raises(Exception, match="2 shapes for 1 rows"):
        shapefile.read_shapefiles(spark, str(tmp_path)).collect()
    (tmp_path / "b" / "same.dbf").unlink()
    with pytest.raises(Exception, match="dbf is missing"):
        shapefile.read_shapefiles(spark, str(tmp_path)).collect()


def test_ring_parts(spark):
    df = spark.sql("SELECT array(named_struct('x', 0D, 'y', 0D), named_struct('x', 2D, 'y', 0D), named_struct('x', 2D, 'y', 2D)) AS points, array(0) AS parts")
    r = g.split_parts(F.col("points"), F.col("parts"))
    assert df.select(g.area(g.outer_ring(r)).alias("a")).first().a == 2.0


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.md").write_text("text")
    assert [tuple(r) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("sub/a b.md", "text")]
    (tmp_path / "q.json").write_text('[{"id": "1", "question": "q", "required_items": ["a"]}]')
    r = files.read_queries(spark, str(tmp_path / "q.json")).first()
    assert r.gold_ready is True and r.required_attachments == []


def test_command_line(spark, tmp_path, capsys):
    from zoneweave import __main__ as cli

    (tmp_path / "law.md").write_text(LAW)
    assert "제4조의2" in cli.answer(spark, "높이는 얼마인가", str(tmp_path), mode="tfidf")
    assert cli.main(["list"]) == 0 and "floor_summary" in capsys.readouterr().out.split()
    with pytest.raises(SystemExit):
        cli.main(["run", "no such query", "--data", "x"])


def test_needles_in_pages(spark, monkeypatch):
    from zoneweave.operators import needles

    texts = ["one two three", "two", None, "threeone", ""]
    words = ["one", "two", "three", "ee", "absent", "", None]
    df, w = spark.createDataFrame(list(enumerate(texts)), "k int, t string"), spark.createDataFrame([(x,) for x in words], "w string")
    want = sorted((i, x) for i, t in enumerate(texts) for x in words if t and x and x in t)
    for page, size in ((50_000, 8 << 20), (2, 8 << 20), (3, 4)):
        monkeypatch.setattr(needles, "NEEDLES", page)
        monkeypatch.setattr(needles, "CHARS", size)
        assert sorted(tuple(r) for r in needles.find_needles(df, ["k"], F.col("t"), w, "w").collect()) == want


def test_index_is_stored_once(spark, tmp_path):
    c = spark.createDataFrame([(1, "a", "red apple pie"), (2, "b", "green apple tart")], "chunk_id long, source string, text string")
    q = spark.createDataFrame([(1, "red apple")], "item_id long, question string")
    plain = sorted(map(tuple, retrieval.lexical_scores(retrieval.Index(c), q).collect()))
    for _ in range(2):
        stored = retrieval.Index.stored(c, str(tmp_path))
        assert sorted(map(tuple, retrieval.lexical_scores(stored, q).collect())) == [pytest.approx(r) for r in plain]
    retrieval.Index.stored(c.where("chunk_id = 1"), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2  # another corpus, another index
