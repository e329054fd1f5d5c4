"""Operator 13 against a plain alignment of one text after another."""

from collections import Counter
from hashlib import sha256

import pytest
from folioforge.llm import alignment

A, B = alignment.public_pair()


def tokens():
    import sentencepiece
    from folioforge.llm.bpe import byte_table
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    m = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: b for b, c in enumerate(byte_table())}

    def of_a(text):
        return [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]

    def of_b(text):
        piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
        return [(i, piece(i)) for i in m.encode(text)]

    return of_a, of_b


def plain(rows):
    """(key, text) rows, by the definition: groups first, then counts over all rows."""
    of_a, of_b = tokens()
    groups = []
    for _, text in rows:
        found = []
        if text:
            a, b = of_a(text), of_b(text)
            want = (" " + text).encode()
            if b"".join(x for _, x in a) == want == b"".join(x for _, x in b):
                i = j = at_a = at_b = 0
                open_a, open_b = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b:
                        at_a += len(a[i][1])
                        open_a.append(a[i][0])
                        i += 1
                    else:
                        at_b += len(b[j][1])
                        open_b.append(b[j][0])
                        j += 1
                    if at_a == at_b:
                        found.append((open_a, open_b))
                        open_a, open_b = [], []
        groups.append(found)
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for each in links for p in each)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (key, _), g, each in zip(rows, groups, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(each.values()),
            sum(n for p, n in each.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in each.items()), sha256(text.encode()).hexdigest() if g else "",
        ))
    return out


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "\n\n\tx\r\n", "<|endoftext|> <s> </s> <unk> <0x41>", "naïve café — 漢字かな交じり文 🙂🙃", "▁ taken", "x" * 3000, " " * 300,
    "hello hello hello world", "hello hello hello world", "​﻿\x00\x7f", "1234567890 3.14159", "é é",
]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())))


@pytest.mark.parametrize("common", [alignment.COMMON_PAIRS, 20, 0])
def test_odd_texts(spark, common):
    rows = list(enumerate(TEXTS)) + [(None, "hello world"), (3, "a"), (3, "a")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, pair string, links int").repartition(3)
    assert rows_of(alignment.digest(docs, A, B, common=common)) == sorted(map(repr, plain(rows)))


def test_whole_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = alignment.op13_alignment(spark, data)
    assert dict(found.dtypes) == {"doc_id": "bigint", "groups_sha256": "string"} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), "bigint")
    assert rows_of(found) == sorted(map(repr, plain(rows)))


def test_long_texts_in_pieces_and_many_links(spark, data, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").orderBy("doc_id").collect() if r.text]
    long = " ".join(texts[:40]) + "  \n " + "abc" * 700 + " " * 50 + "漢字" * 300
    a, b = alignment.byte_side(A), alignment.piece_side(B)
    whole = [s.encode([long])[0] for s in (a, b)]
    monkeypatch.setattr(alignment, "PIECE_CHARS", 300)
    assert [s.encode([long])[0] for s in (a, b)] == whole
    x = alignment.Batch(a, b, [long, "", *texts[:3]])
    once = x.pairs()
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 7)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 2)
    assert all((p == q).all() for p, q in zip(once, x.pairs()))


def test_pairs_in_several_rows(spark):
    rows = [(1, "many different words stand here, one after another"), (2, "many other words")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {r.key: dict(zip(r.pairs, r.links)) for r in alignment.linked(docs, A, B).collect()}
    kept, alignment.ROW_PAIRS = alignment.ROW_PAIRS, 3
    try:
        parts = alignment.linked(docs.coalesce(1), A, B).collect()
    finally:
        alignment.ROW_PAIRS = kept
    assert max(r.part for r in parts) > 1 and all(len(r.pairs) <= 3 for r in parts)
    again = {}
    for r in parts:
        again.setdefault(r.key, {}).update(zip(r.pairs, r.links))
    assert again == whole


def test_groups(spark):
    rows = [(1, "hello world"), (2, None), (3, "漢")]
    found = {r.doc_id: [(g.a, g.b) for g in r.groups] for r in alignment.align(spark.createDataFrame(rows, "doc_id bigint, text string"), A, B).collect()}
    of_a, of_b = tokens()
    assert found[2] == []
    for k, text in ((1, "hello world"), (3, "漢")):
        assert [i for a, _ in found[k] for i in a] == [i for i, _ in of_a(text)] and [i for _, b in found[k] for i in b] == [i for i, _ in of_b(text)]


def test_empty_table_and_clashing_key(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.digest(docs, A, B).count() == 0
    with pytest.raises(ValueError):
        alignment.digest(docs.withColumnRenamed("doc_id", "n_a"), A, B, "n_a")
