"""Golden cases and edge cases of the library's operators."""

import json
import time
import random
import zipfile

import numpy as np
import pytest
from folioforge.functions import html as hx
from folioforge.functions import text as tx
from folioforge.operators import cdc, cluster, library, provenance, retrieval, set_blocks, telemetry
from folioforge.operators.components import connected_components
from folioforge.sources import files
from folioforge.streaming import jobs
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_components_against_union_find(spark):
    random.seed(2)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(400, i) for i in range(401, 470)] + [(i, i + 1) for i in range(500, 560)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 1)], "src long, dst long")
    assert {r.node: r.component for r in connected_components(df).collect()} == {x: find(x) for x in linked}
    assert connected_components(df.limit(0)).count() == 0


def test_chunks_drop_headings(spark):
    text = "教育\n\n学前教育。\n\n义务教育\n\n开放教育 成人教育 特殊教育\n\n2021年，全区共有各级各类学校212所，在校生117679人。"
    rows = tx.chunks(spark.createDataFrame([(1, text), (2, None), (3, "　 ")], "id int, text string"), "id", "text").collect()
    assert [(r.id, r.position, r.text[:5]) for r in rows] == [(1, "第2段", "学前教育。"), (1, "第5段", "2021年")]


def test_title_bonus_keeps_every_chunk(spark):
    docs = spark.createDataFrame([(1, "新区经济发展概况", "2020年新区经济总量较快。\n第二段没有关系2。"), (2, "某区教育报告", "内容无关1。")], "id int, title string, text string")
    assert [(r.id, r.position) for r in retrieval.lexical(docs, "新区经济发展", "id", "title", "text").orderBy("paragraph").collect()] == [(1, "第1段"), (1, "第2段")]
    assert retrieval.lexical(docs, " ", "id", "title", "text").count() == 0


def test_pairs_and_dice(spark):
    assert one(spark, tx.bigrams(F.lit("a b　c"))) == ["ab", "bc"]
    assert one(spark, tx.bigrams(F.lit("a"))) == [] and one(spark, tx.bigrams(F.lit("😀b"))) == ["😀b"]
    assert one(spark, tx.dice(tx.bigrams(F.lit("aaaa")), tx.bigrams(F.lit("aa")))) == 2 * 3 / 4


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, retrieval.cosine(v(1, 0, 0), v(1, 0, 0))) == 1
    assert one(spark, retrieval.cosine(v(1, 0, 0), v(0, 1, 0))) == 0
    assert one(spark, retrieval.cosine(v(0, 0, 0), v(0, 1, 0))) == 0


def test_numeric_entities(spark):
    assert one(spark, hx.strip_tags(F.lit("<a>&#65;&#20013; &amp;lt;</a><script>x</script>"))) == "A中 <"


def test_cascade_and_set_null(spark):
    t = {"p": spark.createDataFrame([(1,), (2,)], "id int"), "c": spark.createDataFrame([(10, 1), (11, 2)], "id int, p_id int"), "n": spark.createDataFrame([(5, 1), (6, 2)], "id int, p_id int")}
    left = library.cascade(t, [("p", "id", "c", "p_id", "cascade"), ("p", "id", "n", "p_id", "set null")], "p", spark.createDataFrame([(1,)], "id int"), "id")
    assert [r.id for r in left["c"].collect()] == [11]
    assert {r.id: r.p_id for r in left["n"].collect()} == {5: None, 6: 2}


def test_upsert_last_wins(spark):
    base = spark.createDataFrame([("a", "old")], "url string, title string")
    delta = spark.createDataFrame([("a", "x", 1), ("a", "new", 2), ("b", "y", 3)], "url string, title string, n int")
    assert {r.url: r.title for r in library.upsert(base, delta, ["url"], "n").collect()} == {"a": "new", "b": "y"}


def test_moves_need_a_vanished_path(spark):
    old = spark.createDataFrame([("old/doc.md", "h1"), ("gone.txt", "h2")], "path string, hash string")
    new = spark.createDataFrame([("new/doc.md", "h1"), ("more.txt", "h3")], "path string, hash string")
    d = cdc.diff(old, new)
    assert {r.path: r.change for r in d.collect()} == {"old/doc.md": "removed", "new/doc.md": "added", "gone.txt": "removed", "more.txt": "added"}
    assert [tuple(r) for r in cdc.moves(d).collect()] == [("h1", "old/doc.md", "new/doc.md")]


def test_topic_edges_against_all_pairs(spark):
    random.seed(4)
    sets = {i: set(random.sample("abcdefghijkl", random.randint(1, 9))) for i in range(40)}
    df = spark.createDataFrame([(i, g) for i, s in sets.items() for g in s], "id int, gram string")
    for least in (0.12, 0.5, 0.8, 1.0):
        expected = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) >= least}
        assert {(r.a, r.b) for r in cluster.topic_edges(df, "id", least).collect()} == expected


def test_model_calls_retry_and_keep_errors(spark):
    def client(prompt, temperature):
        if prompt == "bad":
            raise ValueError("no")
        return "ok" if temperature >= 0.3 else ""

    rows = telemetry.call_model(spark.createDataFrame([(1, "a"), (2, "bad")], "id int, p string"), "id", "p", client, sleep=lambda s: None).collect()
    assert [(r.reply, r.attempts, r.error, r.input_chars, r.output_chars, r.status) for r in sorted(rows)] == [("ok", 2, None, 1, 2, "ok"), (None, 3, "no", 3, 0, "error")]


def test_waits_between_failed_calls(spark, tmp_path):
    log = str(tmp_path / "waits")

    def client(prompt, temperature):
        raise ValueError("no")

    def sleep(seconds):
        with open(log, "a") as f:
            f.write(f"{seconds}\n")

    telemetry.call_model(spark.createDataFrame([(1, "a")], "id int, p string"), "id", "p", client, (0, 0, 0, 0, 0), sleep=sleep).collect()
    assert open(log).read().split() == ["0.8", "2.0", "4.0", "4.0"]


def test_interrupted_swaps_are_recovered(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda: sorted(r.id for r in spark.read.parquet(path).collect())
    assert not library.recover(spark, path)
    library.save_next(spark.range(3), path)
    (tmp_path / "t").rename(tmp_path / "t._old")  # a crash between both renames
    spark.range(9).write.parquet(path + "._next")
    assert library.recover(spark, path) and rows() == [0, 1, 2]
    library.save_next(spark.range(5), path)
    assert rows() == [0, 1, 2, 3, 4] and not (tmp_path / "t._old").exists() and not (tmp_path / "t._next").exists()


def test_merge_with_deletes_and_known_content(spark, tmp_path):
    src, table, cp = (str(tmp_path / x) for x in ("in", "table", "cp"))
    schema, seen = "path string, hash string, n int, gone boolean", []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(src)
    for batch in (
        [("a", "h1", 1, False), ("b", "h2", 1, False), ("c", "h2", 1, False)],
        [("a", "h9", 2, False), ("b", "h2", 2, True), ("d", "h9", 2, False), ("e", "h5", 2, False), ("e", "h6", 3, False)],
    ):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.merge_batches(stream, table, "path", "n", cp, lambda d: seen.append(sorted(r.path for r in d.collect())), "gone", "hash").awaitTermination(120)
    assert {r.path: r.hash for r in spark.read.parquet(table).collect()} == {"a": "h9", "d": "h9", "e": "h6"}
    assert seen == [["a", "b"], ["a", "d", "e"]]


def test_bursts_are_one_row(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("a", "2024-01-01 00:00:00.0"), ("a", "2024-01-01 00:00:00.3"), ("a", "2024-01-01 00:00:02"), ("b", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:01:00")]
    spark.createDataFrame(rows, "path string, at string").selectExpr("path", "to_timestamp(at) AS at").coalesce(1).write.parquet(src)
    bursts = jobs.debounced(spark.readStream.schema("path string, at timestamp").parquet(src), "path", "at")
    bursts.writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted((r.path, r.n) for r in spark.sql("SELECT * FROM bursts").collect())[:3] == [("a", 1), ("a", 2), ("b", 1)]


def test_full_text_without_a_word(spark):
    docs = spark.createDataFrame([(1, "one two two"), (2, "one"), (3, None)], "id int, text string")
    assert retrieval.full_text(docs, "  ", "id", "text").count() == 0
    assert [r.id for r in retrieval.full_text(docs, "two ONE", "id", "text").collect()] == [1]


def test_later_stages_of_a_trace(spark):
    docs = spark.createDataFrame([(1, "t", "alpha beta 1."), (2, "t", "gamma delta 2.")], "id int, title string, text string")
    context = spark.createDataFrame([(2, 1, "gamma delta")], "id int, position int, chunk string")
    stages = lambda sel, **k: [tuple(r) for r in provenance.trace(docs, context, sel, "id", "title", "text", **k).collect()]
    assert stages("beta 1") == [(1, "exact")] and stages("ga mm") == [(2, "context")]
    assert stages("beta alph") == [(2, "context")] or stages("beta alph") == [(1, "retrieval")]
    assert stages("zz") == [] and stages("zz", client=lambda s: [7]) == [(7, "model")]


def test_references_and_text(spark):
    valid = F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"))
    cut = lambda t: [(x.ref, x.text) for x in one(spark, provenance.split_refs(F.lit(t), valid))]
    assert cut("来源 #1 与 #2。") == [(None, "来源 "), (1, "#1"), (None, " 与 "), (2, "#2"), (None, "。")]
    assert cut("【矛盾#3】#99999999999999999999") == [(None, "【矛盾#3】#99999999999999999999")] and cut("") == []


def test_edits_are_all_or_nothing(spark):
    edits = lambda *e: F.array(*[F.struct(F.lit(a).alias("anchor"), F.lit(b).alias("replacement")) for a, b in e])
    assert one(spark, tx.apply_edits(F.lit("a b a"), edits(("a", "X"), ("b a", "Y")))) == "X Y"
    assert one(spark, tx.apply_edits(F.lit("a b a"), edits(("a", "X"), ("zz", "Y")))) is None


def test_fuzzy_names_tags_and_content(spark):
    hit = lambda name, tags, content: one(spark, tx.fuzzy_match(F.lit(name), "A.c", F.array(*map(F.lit, tags)) if tags else F.array().cast("array<string>"), F.lit(content)))
    assert hit("xa.cx", [], "") and hit("xaz.zzC", [], "") and hit("x", ["n", "a.bc"], "") and hit("x", [], "Xa.C")
    assert not hit("x", ["abc"], "a. c")


def test_sheets_by_relationship(tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    path = tmp_path / "b.xlsx"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="First" r:id="r9"/><sheet name="Second" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r9" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        for i, v in ((1, "one"), (2, "two")):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="B3" t="inlineStr"><is><t>{v}</t></is></c></row></sheetData></worksheet>')
    assert files.parse_xlsx(path.read_bytes()) == "【工作表：First】\n第3行第2列：two\n【工作表：Second】\n第3行第2列：one"


def test_floats_from_bytes(spark):
    import struct

    values = [0.0, -0.0, 1.5, -3.25e-20, 3.4028234663852886e38, 1e-45, 1.17549435e-38, float("inf"), float("-inf"), 0.1]
    data = struct.pack(f"<{len(values)}f", *values)
    got = one(spark, retrieval.float_vector(F.lit(bytearray(data))))
    assert struct.pack(f"<{len(values)}f", *got).replace(b"\x00\x00\x00\x80", bytes(4)) == data.replace(b"\x00\x00\x00\x80", bytes(4))
    assert one(spark, retrieval.float_vector(F.lit(bytearray()))) == [] and one(spark, retrieval.float_vector(F.lit(bytearray(b"abc")))) is None
    back = one(spark, retrieval.float_bytes(F.array(*[F.lit(v).cast("float") for v in values])))
    assert bytes(back).replace(b"\x00\x00\x00\x80", bytes(4)) == data.replace(b"\x00\x00\x00\x80", bytes(4))


def test_equal_sets_are_one_class(spark):
    grams = spark.createDataFrame([(i, g) for i in range(50) for g in ("ab", "bc")] + [(90, "ab"), (90, "bc"), (90, "cd"), (91, "zz")], "id int, gram string")
    edges = cluster.class_edges(grams, "id", 0.7).collect()
    assert len(edges) == 50 and {(r.a, r.b) for r in edges} == {(0, i) for i in [*range(1, 50), 90]}
    found = cluster.topic_clusters(grams, spark.createDataFrame(edges), "id").collect()
    assert {r.id: r.cluster for r in found} == {**{i: 0 for i in range(50)}, 90: 0, 91: 91}


def test_clusters_without_all_links(spark):
    rng = random.Random(8)
    for letters, most, least in (("abcdefghijkl", 9, 0.12), ("abcdefghijklmnopqrstuvwxyz", 4, 0.4), ("abcdefghijklmnopqrstuvwxyz", 6, 0.75), ("abcdefghijklmnopqrstuvwxyz", 3, 1.0)):
        sets = {i: set(rng.sample(letters, rng.randint(1, most))) for i in range(60)}
        parent = {i: i for i in sets}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a in sets:
            for b in sets:
                if a < b and 2 * len(sets[a] & sets[b]) / (len(sets[a]) + len(sets[b])) >= least:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
        df = spark.createDataFrame([(i, g) for i, s in sets.items() for g in s], "id int, gram string")
        assert {r.id: r.cluster for r in cluster.linked_clusters(df, "id", least, tries=1, rounds=3).collect()} == {i: root(i) for i in sets}
    assert cluster.linked_clusters(df.limit(0), "id").count() == 0


def plain_windows(rows, most):
    """(key, order, size) rows in order."""
    found, open_ = {}, {}
    for k, i, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        n = n or 0
        used, nr = open_.get(k, (0, 0))
        used, nr = (n, nr + 1) if not nr or used + n > most else (used + n, nr)
        open_[k] = used, nr
        found[k, i] = nr
    return found


def test_windows_of_keys_that_lie_in_many_tasks(spark):
    rng = random.Random(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for most in (1, 7, 50, 10_000):
            rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), i, rng.choice([None, 0, 0, 1, 3, 9, 40])) for i in range(400)]
            df = spark.createDataFrame(rows, "k int, i int, n int").repartition(3)
            got = {(r.k, r.i): r.window for r in cluster.greedy_windows(df, "k", ["i"], "n", most).collect()}
            assert got == plain_windows(rows, most)
        assert cluster.greedy_windows(df.limit(0), "k", ["i"], "n", 5).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_windows_stream_in_order(spark):
    rows = spark.createDataFrame([(1, i, 200) for i in range(3)] + [(2, 0, 900), (2, 1, 1), (3, 0, None)], "k int, i int, n int")
    found = {(r.k, r.i): r.window for r in cluster.greedy_windows(rows, "k", ["i"], "n", 500).collect()}
    assert found == {(1, 0): 1, (1, 1): 1, (1, 2): 2, (2, 0): 1, (2, 1): 2, (3, 0): 1}
    big = spark.range(200_000).selectExpr("1 AS k", "id AS i", "1 AS n")
    assert cluster.greedy_windows(big, "k", ["i"], "n", 10).agg(F.max("window")).first()[0] == 20_000


def test_json_field_in_pieces():
    text = json.dumps({"title": "t", "content": 'a"b\\c\n中\u0001d', "x": 1})
    for size in (1, 3, 5, 100):
        state, out = "", ""
        for i in range(0, len(text), size):
            more, state = jobs.json_field_step("content", state, text[i : i + size])
            out += more
        assert out == 'a"b\\c\n中\u0001d'
    assert jobs.json_field_step("content", "", '{"content": null}')[0] == ""


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 0, '{"content": "He'), (1, 1, 'llo"}'), (2, 0, '{"content": "x'), (3, 0, "start")], "id int, n int, piece string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("id int, n int, piece string").parquet(src)
    q = jobs.stream_field(stream, "id", "n", "piece", "content").writeStream.format("memory").queryName("fields").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: r.delta for r in spark.sql("SELECT * FROM fields").collect()} == {1: "Hello", 2: "x", 3: ""}
    q = jobs.index_states(stream.where("id = 3"), "id", "n", "piece").writeStream.format("memory").queryName("states").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.state for r in spark.sql("SELECT * FROM states").collect()] == ["indexing"]


def test_files_scan_parse_and_watch(spark, tmp_path):
    d = tmp_path / "lib"
    (d / ".git").mkdir(parents=True)
    (d / "a.txt").write_text("hello")
    (d / ".git" / "c.md").write_text("x")
    (d / "b.exe").write_text("x")
    with zipfile.ZipFile(d / "w.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t></w:p><w:p><w:t>Two</w:t></w:p></w:document>')
    (d / "p.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.error_code) for r in files.parse(files.scan(spark, str(d))).collect()}
    assert rows == {"a.txt": ("hello", None), "w.docx": ("One\n\nTwo", None), "p.pdf": (None, "PARSE_UNSUPPORTED")}
    table = str(tmp_path / "table")
    jobs.merge_batches(jobs.watch_files(spark, str(d)), table, "path", "mtime", str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(table).count() == 4


def test_reconcile_with_a_whole_snapshot(spark, tmp_path):
    at, schema = str(tmp_path / "table"), "path string, hash string, n int"
    do = lambda rows: {r.change: r.n for r in jobs.reconcile(spark.createDataFrame(rows, schema), at).collect()}
    assert do([("A\\b.txt", "1", 1), ("c", "2", 1)]) == {"added": 2}
    assert do([("a/b.txt", "1", 2), ("c", "3", 2), ("d", "4", 2)]) == {"same": 1, "changed": 1, "added": 1}
    assert {(r.path, r.hash, r.n) for r in spark.read.parquet(at).collect()} == {("A\\b.txt", "1", 1), ("c", "3", 2), ("d", "4", 2)}
    assert do([]) == {"removed": 3} and spark.read.parquet(at).count() == 0


def test_progress_is_told(spark, tmp_path):
    src, told = str(tmp_path / "in"), []
    spark.range(3).write.parquet(src)
    listener = jobs.Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    try:
        q = spark.readStream.schema("id bigint").parquet(src).writeStream.format("noop").queryName("told").trigger(availableNow=True).start()
        q.awaitTermination(120)
        for _ in range(100):
            if told:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0][:3] == ("told", 0, 3)


@pytest.mark.parametrize("bits", [set_blocks.BITS, 0])
def test_blocks_of_sets_against_all_pairs(bits, monkeypatch):
    monkeypatch.setattr(set_blocks, "BITS", bits)
    monkeypatch.setattr(set_blocks, "DENSE", 20)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.choice(90, rng.integers(1, 60))) for _ in range(120)]
    sets += [np.union1d(s, [91]) for s in sets[:30]]
    a, b = (set_blocks.Block(*set_blocks.Block.packed(x)) for x in (sets[:70], sets[70:]))
    for least in (0.12, 0.5, 0.9, 1.0):
        dice = lambda x, y: 2.0 * len(np.intersect1d(x, y)) / (len(x) + len(y))
        expected = {(i, j, d) for i, x in enumerate(sets[:70]) for j, y in enumerate(sets[70:]) if (d := dice(x, y)) >= least}
        assert {(i, j, d) for x, y, d in set_blocks.alike(a, b, least) for i, j, d in zip(x.tolist(), y.tolist(), d.tolist())} == expected
        own = {(i, j) for i in range(70) for j in range(i + 1, 70) if dice(sets[i], sets[j]) >= least}
        assert {p for x, y, _ in set_blocks.alike(a, a, least, same=True) for p in zip(x.tolist(), y.tolist())} == own


def test_links_have_the_components_of_all_edges(spark, monkeypatch):
    rng = random.Random(2)
    sets = {i: rng.sample("abcdefghijklmnopqrstuvwxyz", rng.randint(2, 5)) for i in range(80)}
    lists = spark.createDataFrame(list(sets.items()), "id int, grams array<string>")
    sources = lists.select("id")
    for least in (0.5, 0.7):
        edges = cluster.list_edges(lists, "id", least)
        links = cluster.list_links(lists, "id", least)
        assert sorted(cluster.topic_clusters(sources, links, "id").collect()) == sorted(cluster.topic_clusters(sources, edges, "id").collect())
    assert cluster.list_links(lists.limit(0), "id").count() == 0


def test_grams_of_a_source_in_one_row(spark):
    chunks = spark.createDataFrame([(1, 2, "bcd"), (1, 1, "ab c"), (1, 3, "xy"), (2, 1, "a"), (3, 1, None), (4, 1, "\x00\U0001f600\x00")], "id int, n int, t string")
    found = {r.id: sorted(r.grams) for r in cluster.gram_lists(chunks, "id", ["n"], "t", most=2).collect()}
    assert found == {1: ["ab", "bc", "cd"], 4: ["\x00\U0001f600", "\U0001f600\x00"]}
    plain = cluster.gram_sets(chunks, "id", ["n"], "t", most=2).groupBy("id").agg(F.array_sort(F.collect_list("gram")).alias("g"))
    assert {r.id: sorted(r.g) for r in plain.collect()} == found


def test_groups_of_a_scope_are_merged_in_order(spark):
    v = lambda *x: [(t, list(r)) for t, r in x]
    rows = [
        (1, 3, "founding year", "time", v(("b", ["#3", "#1"]), ("a", ["#9"]))),
        (1, 1, "founding year", None, v(("a", ["#1", "#2", "#1"]))),
        (1, 2, "a", "fact", v(("x", ["#1"]))),
        (1, 4, "a", "fact", v(("x", ["#2"]), (None, []))),
        (1, 5, "founding  years", "data", v(("c", ["#4"]))),
        (2, 1, "founding year", "", v(("a", ["#5"]))),
        (None, 1, "other", "place", v(("a", ["#6"]))),
    ]
    df = spark.createDataFrame(rows, "draft int, id int, topic string, kind string, variants array<struct<text:string,sourceRefs:array<string>>>")
    merged = cluster.merge_groups(df, "draft", "id")
    assert "InPandas" not in merged._jdf.queryExecution().executedPlan().toString()  # a pandas frame for each scope
    found = {(r.draft, r.nr): (r.topic, r.kind, [(x.text, x.sourceRefs) for x in r.variants]) for r in merged.collect()}
    assert found == {
        (1, 1): ("founding year", "time", [("a", ["#1", "#2", "#9"]), ("b", ["#3", "#1"]), ("c", ["#4"])]),
        (1, 2): ("a", "fact", [("x", ["#1"])]),
        (1, 3): ("a", "fact", [("x", ["#2"]), (None, [])]),
        (2, 1): ("founding year", "", [("a", ["#5"])]),
        (None, 1): ("other", "place", [("a", ["#6"])]),
    }
    assert cluster.merge_groups(df.limit(0), "draft", "id").count() == 0


def test_clusters_of_lists_without_rounds(spark):
    sets = {1: ["ab", "bc"], 2: ["bc", "cd"], 3: ["xy", "yz"], 4: ["yz", "zz"], 5: ["qq", "rr"], 6: ["ab", "bc"]}
    lists = spark.createDataFrame(list(sets.items()), "id int, grams array<string>")
    found = {r.id: r.cluster for r in cluster.linked_lists(lists, "id", 0.5, rounds=0, pairs=True).collect()}
    assert found == {1: 1, 2: 1, 6: 1, 3: 3, 4: 3, 5: 5}
