import random

from edge import documents
from folioforge.llm import linededup as ld
from pyspark.sql import functions as F


def shingles(line, n=ld.SHINGLE_CHARS):
    line = line.ljust(n, "\0")
    return {line[i : i + n] for i in range(len(line) - n + 1)}


def similar(a, b, least=ld.SIMILARITY):
    return len(a & b) >= least * len(a | b)


def expected(docs, least=ld.SIMILARITY):
    first = {}
    for k, t in docs:
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(ld.BLANKS):
                first.setdefault(line, (k, p))
    lines = list(first)
    sets = [shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for j in range(len(lines)):
        for i in range(j):
            if similar(sets[i], sets[j], least):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    best = {}
    for i, x in enumerate(lines):
        best[find(i)] = min(best.get(find(i), first[x]), first[x])
    keep = {x: best[find(i)] for i, x in enumerate(lines)}
    return {k: "\n".join(x for p, x in enumerate((t or "").split("\n")) if not x.strip(ld.BLANKS) or keep[x] == (k, p)) for k, t in docs}


def test_against_all_pairs(spark, data):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    assert {r.doc_id: r.text for r in ld.op6_line_dedup(spark, data).collect()} == expected(docs)


def test_recall_at_the_threshold():
    random.seed(1)
    met = total = 0
    for _ in range(300):
        a = "".join(random.choice("abcdefghij klmnop") for _ in range(200))
        b = a[:-11] + "".join(random.choice("QRSTUVWXYZ") for _ in range(11))  # similarity just over 0.8
        x, y = shingles(a), shingles(b)
        if similar(x, y):
            total += 1
            k = ld.band_keys([a, b])
            met += bool((k[0] == k[1]).any())
    assert total > 250 and met / total > 0.97


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return [find(i) for i in range(n)]


def many_alike(n, seed=2):
    """Lines of one template with some words changed, so that they meet in bands and often, but not always, link."""
    rng = random.Random(seed)
    words = [f"common{i}word" for i in range(16)]
    return sorted({" ".join(rng.choice(["other", "thing", w]) if rng.random() < 0.08 else w for w in words) for _ in range(n)})


def test_trees_span_all_pairs():
    lines = many_alike(150) + ["abc", "abcdefgh", "é" * 9, "abc" * 30]
    sets = [shingles(x) for x in lines]
    want = components(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if similar(sets[i], sets[j])])
    links = ld.tree_links([ld.shingles(x) for x in lines])
    assert components(len(lines), links) == want and len(links) == len(lines) - len(set(want))
    assert all(similar(sets[a], sets[b]) for a, b in links)


def test_large_groups_go_by_blocks(spark):
    lines = many_alike(300)
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    whole, blocks = (sorted(components_of(ld.line_links(docs, **k))) for k in ({}, {"block_lines": 7}))
    assert whole == blocks and whole
    assert sorted(components_of(ld.line_links(docs, block_chars=1000))) == whole


def components_of(links):
    rows = links.collect()
    nodes = sorted({x for r in rows for x in r})
    at = {x: i for i, x in enumerate(nodes)}
    return list(zip(nodes, components(len(nodes), [(at[r.src], at[r.dst]) for r in rows])))


def test_long_lines_are_hashed_in_pieces():
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(ld.PIECE * 2 + 77))
    whole, parts = shingles(line), ld.shingles(line)
    assert len(parts) == len(whole)
    short = [line[:300], "abc", line[500:1500]]
    k = ld.band_keys([*short, line, line[:-1]])
    assert (k[:3] == ld.band_keys(short)).all() and (k[3] == k[4]).mean() > 0.8
    piece, ld.PIECE = ld.PIECE, 64
    try:
        assert (ld.band_keys([*short, line]) == k[:4]).all() and (ld.shingles(line) == parts).all()
    finally:
        ld.PIECE = piece


def test_names_that_clash(spark):
    rows = [(1, "one line here\nand another", 5, "x"), (2, "one line here", 6, "y"), (None, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, removed string")
    docs = docs.withColumns({c: F.lit("mine") for c in ("row", "row1", "pos", "left", "lines", "node", "root", "doc", "nth", "every", "_removed")})
    found = {r.doc_id: r for r in ld.dedup_lines(docs).collect()}
    assert found[2].text == "" and found[2].n_lines == 1 and found[2].removed == "y" and found[None].row == "mine" and found[1].nth == "mine"


def test_edges(spark):
    rows = ld.dedup_lines(documents(spark)).collect()
    assert len(rows) == 12 and "component_id" in rows[0].asDict()
    by = {r.doc_id: r for r in rows}
    assert by[1].text and by[2].text == "" and by[2].n_removed == 1
    assert by[3].text is None and by[3].n_lines == 0 and by[5].n_removed == 0
    assert by[8].n_removed == 1 and by[8].n_lines == 2
    assert ld.dedup_lines(documents(spark).limit(0)).count() == 0


def test_rows_that_share_a_key(spark):
    rows = [
        (None, "said twice in here\nonly the first row says this"),
        (None, "said twice in here\nquite another matter of the second"),
        (None, "a third thing without a copy\nsaid twice in here"),
        (7, "equal rows\n\nof one key"),
        (7, "equal rows\n\nof one key"),
        (7, "equal rows\nbut these are new words"),
    ]
    found = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 6
    assert sum(r.n_removed for r in found) == 5 and all(r.n_lines - r.n_removed == len(r.text.split("\n")) for r in found if r.text)
    left = sorted(x for r in found for x in r.text.split("\n") if x)
    assert left == sorted({x for _, t in rows for x in t.split("\n") if x})
