"""Revisions change texts and states together; pooling, paging and matching at their edges."""

import pytest
from folioforge.operators import library, prompts, retrieval, revisions, telemetry
from folioforge.operators.versions import Change, Tables
from pyspark.sql import functions as F


def drafts(spark, tmp_path):
    t = Tables(spark, f"{tmp_path}/t", {"drafts": "draft_id", "contradictions": "contradiction_id", "variants": "contradiction_id"})
    t.commit({
        "drafts": Change(spark.createDataFrame([(1, "a【矛盾#1】 about 30 and 【矛盾#2】old"), (2, None)], "draft_id int, text string")),
        "contradictions": Change(spark.createDataFrame([(10, 1, 1, "pending", "about 30", None), (11, 1, 2, "pending", "about 30", None), (12, 2, 1, "pending", "x", None), (13, 1, 3, "ignored", "a", None), (14, 9, 1, "pending", "a", None), (15, 1, 4, "pending", None, None)], "contradiction_id int, draft_id int, seq int, status string, quote string, variant_id int")),
        "variants": Change(spark.createDataFrame([(10, 1, "31"), (10, 2, "29"), (11, 1, "thirty"), (12, 1, "y"), (13, 1, "b"), (14, 1, "b"), (15, 1, "c")], "contradiction_id int, variant_id int, replacement string")),
    })
    return t


ASKED = [(1, 1, 10, 2), (2, 1, 10, 1), (3, 1, 11, 1), (4, 2, 12, 1), (5, 1, 13, 1), (6, 9, 14, 1), (7, 1, 15, 1), (8, 2, 10, 1), (9, 1, 99, 1), (10, 1, 11, 7)]


def test_adopting(spark, tmp_path, monkeypatch):
    t, asked = drafts(spark, tmp_path), spark.createDataFrame(ASKED, "nr int, draft_id int, contradiction_id int, variant_id int")
    state = lambda: (sorted(map(tuple, t.read("drafts").collect()), key=repr), sorted((r.contradiction_id, r.status, r.variant_id) for r in t.read("contradictions").collect()))
    before = state()
    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Tables, "_publish", lambda *_: (_ for _ in ()).throw(OSError()))
        revisions.adopt(t, asked)
    assert state() == before
    codes = {r.nr: r.code for r in revisions.adopt(t, asked).collect()}
    assert codes == {1: None, 2: "INVALID_PARAM", 3: "EDIT_ANCHOR_NOT_FOUND", 4: "EDIT_ANCHOR_NOT_FOUND", 5: "INVALID_PARAM", 6: "DRAFT_NOT_FOUND", 7: "EDIT_NO_QUOTE", 8: "INVALID_PARAM", 9: "INVALID_PARAM", 10: "INVALID_PARAM"}
    texts, states = state()
    assert dict(texts) == {1: "a 29 and 【矛盾#2】old", 2: None} and states[0] == (10, "adopted", 2) and {s for _, s, _ in states[1:]} == {"pending", "ignored"}
    assert revisions.adopt(t, asked.limit(0)).count() == 0


def test_mean_pooling(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    v = lambda *rows: F.array(*[F.array(*[F.lit(float(x)) for x in r]) for r in rows])
    assert one(retrieval.mean_pooled(v((3, 0), (0, 4), (90, 90)), F.array(F.lit(1), F.lit(1), F.lit(0)))) == pytest.approx([0.6, 0.8])
    assert one(retrieval.mean_pooled(v((3, 4)))) == pytest.approx([0.6, 0.8]) and one(retrieval.mean_pooled(v((0, 0)))) == [0, 0]
    assert one(retrieval.mean_pooled(v((1, 2)), F.array(F.lit(0)))) is None and one(retrieval.mean_pooled(F.lit(None).cast("array<array<float>>"))) is None


def test_pages_are_bounded(spark):
    lines = spark.range(2500).select(F.lit("a").alias("k"), "id", F.concat(F.lit("l"), F.col("id").cast("string")).alias("line"))
    pages = sorted(telemetry.log_pages(lines, ["k"], "id", "line").collect(), key=lambda r: r.page)
    assert [(p.page, p.n) for p in pages] == [(1, 1000), (2, 1000), (3, 500)]
    assert pages[2].text.split("\n")[0] == "# a / 3: 500" and pages[2].text.split("\n")[1:] == [f"l{i}" for i in range(2000, 2500)]


def test_skills_meet_by_what_they_begin_with(spark):
    titles = spark.createDataFrame([(1, "a bcd 教育"), (1, "a bcd 教育"), (2, ""), (3, None), (4, "xyz")], "id int, t string")
    skills = spark.createDataFrame([("s1", "bc", ["zz"]), ("s2", "q", ["教", None]), ("s3", "", [""]), ("s4", None, None), ("s5", "z", ["xy", "xyz"])], "s string, name string, tags array<string>")
    assert sorted((r.id, r.s) for r in library.match_skills(titles, skills, "t", "name", "tags").collect()) == [(1, "s1"), (1, "s1"), (1, "s2"), (1, "s2"), (4, "s5")]


def test_contradiction_lines(spark):
    groups = spark.createDataFrame([("d", 1, "T", "time", 1, "in 1980", ["a", "z"]), ("d", 1, "T", "time", 2, "in 1981", ["b"])], "scope string, seq int, topic string, kind string, variant int, text string, sources array<string>")
    refs = spark.createDataFrame([("d", "a", 1, "One"), ("d", "b", 2, "Two")], "scope string, source_id string, index int, title string")
    assert prompts.contradiction_lines(groups, refs, "scope").first().lines == "- 矛盾 #1（时间）：T——in 1980（《One》、《z》）；in 1981（《Two》）"
    assert prompts.contradiction_lines(groups, refs, "scope", places=True).first().lines == "- 矛盾 #1（时间）：T——说法 1：in 1980（来源：#1、?）；说法 2：in 1981（来源：#2）"


def test_what_a_writing_model_says(spark):
    said = {
        '{"title": " a ", "content": "b"}': ("a", "b", None), '{"title": "a", "content": " "}': None, '{"title": "a"}': None, '{"title": 1, "content": "b"}': None, "no": None, "": None, None: None,
        '{"error": " bad ", "title": "a", "content": "b"}': (None, None, "bad"), '{"error": 5, "title": "a", "content": "b"}': ("a", "b", None), '```json\n{"title":"a","content":"b"}\n```': ("a", "b", None),
        'x {"title":"a","content":"b", "error": ""} y': ("a", "b", None), '[{"title":"a","content":"b"}]': None, '"text"': None,
    }
    rows = spark.createDataFrame([(k,) for k in said], "t string").select("t", telemetry.draft_output(F.col("t")).alias("x")).collect()
    assert {r.t: r.x and tuple(r.x) for r in rows} == said


def test_titles_lose_their_tags(spark):
    titles = ["[tag:a] [tag:b]\u3000x ", "[tag:a]", "x [tag:a]", "[tag:]x", "[TAG:a] x ", "", None, " x ", "[tag:a\n]x"]
    found = library.untag_titles(spark.createDataFrame(list(enumerate(titles)), "id int, title string"), "id", "title", F.lit(1))
    assert sorted((r.id, r.title) for r in found.collect()) == [(0, "x"), (1, ""), (4, "[TAG:a] x")]


def test_places_are_kept_by_seq_and_number(spark):
    c = spark.createDataFrame([(1, "d", 1), (2, "d", 2), (3, "d", 2), (4, "e", 1)], "contradiction_id int, draft_id string, seq int")
    v = spark.createDataFrame([(1, 11, 9), (1, 12, 5), (3, 31, 0), (4, 41, 0)], "contradiction_id int, variant_id int, position int")
    kind = "draft_id string, nth int, seq int, quote string, merged boolean, replacements array<struct<variant:int,text:string>>"
    located = spark.createDataFrame([("d", 1, 1, "old", True, [(1, "first")]), ("d", 2, 1, "new", None, [(2, "second"), (2, "third"), (7, "none"), (None, "x")]), ("d", 3, 2, "", True, None), ("d", 4, None, "q", True, []), ("x", 1, 1, "q", True, [])], kind)
    quotes, replaced = revisions.place(c, v, located, ["position"])
    assert sorted(map(tuple, quotes.collect())) == [(1, "new", False, True), (3, None, True, False)]
    assert sorted(map(tuple, replaced.collect())) == [(11, "third"), (12, "first")]
    assert [x.count() for x in revisions.place(c, v, located.limit(0), ["position"])] == [0, 0]


def test_lengths_of_json_add_up(spark):
    rows = spark.createDataFrame([(1, "u", 'a"b'), (1, None, "é\n"), (2, "x", None), (None, "x", "y")], "k int, role string, text string")
    whole = {r.k: len(r.j) for r in rows.groupBy("k").agg(F.to_json(F.collect_list(F.struct("role", F.col("text").alias("content")))).alias("j")).collect()}
    assert {r.k: r.n_chars for r in telemetry.json_chars(rows, "k", {"role": "role", "content": "text"}).collect()} == whole


def test_tasks_share_a_list_of_sources(spark):
    groups = spark.createDataFrame([(t, t % 2, 1, "T", "time", v, f"in {v}", [f"s{v}", "s9"]) for t in range(4) for v in (1, 2)], "scope int, list int, seq int, topic string, kind string, variant int, text string, sources array<string>")
    shared = spark.createDataFrame([(i % 2, f"s{i}", i, f"Title {i}") for i in range(1, 5)], "list int, source_id string, index int, title string")
    own = groups.select("scope", "list").distinct().join(shared, "list")
    chunks = groups.select("scope", "list", "variant", F.get("sources", F.lit(0)).alias("source"), F.lit("t").alias("title"), F.lit("p").alias("place"), "text")
    for places in (False, True):
        found, plain = (prompts.contradiction_lines(groups, r, "scope", places, by).collect() for r, by in ((shared, "list"), (own, None)))
        assert len(found) == 4 and sorted(found) == sorted(plain)
    found, plain = (prompts.numbered_materials(chunks, r, "scope", ["variant"], "source", "title", "place", "text", by).select("scope", "files", "materials").collect() for r, by in ((shared, "list"), (own, None)))
    assert len(found) == 4 and sorted(found) == sorted(plain) and found[0].files
