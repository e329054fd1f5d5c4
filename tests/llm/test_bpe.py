import base64
import hashlib

import tiktoken
import pytest
from edge import documents
from folioforge.llm import bpe

PATH, PATTERN = bpe.public_ranks()


def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(x):
    return hashlib.sha256(x).hexdigest()


def test_digest_is_tiktokens(spark, data):
    enc = reference()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op2_bpe(spark, data).collect()}
    ids = {k: enc.encode_ordinary(t) for k, t in texts.items()}
    assert found == {k: (len(ids[k]), sha(",".join(map(str, ids[k])).encode()), sha(t.encode())) for k, t in texts.items()}


def test_round_trip_offsets_and_edges(spark):
    odd = ["", "\n\na  b", " x y", "x \n y", "tab\tb", "\x1c a", "日本語 😀😀", "a\u0085b", "don't", "aaaa" * 60, "a　b", ("w  \n and, m" * 4000) + "x" * 9000 + " y z" * 60000]
    enc = reference()
    df = spark.createDataFrame([*enumerate(odd), (99, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in bpe.encode(df, PATH, PATTERN, offsets=True).collect()}
    for i, t in enumerate(odd):
        assert rows[i].ids == enc.encode_ordinary(t)
        for start, end, token in zip(rows[i].starts[:200], rows[i].ends, rows[i].ids):
            assert t[start:end].encode().find(enc.decode_single_token_bytes(token)) >= 0
    assert rows[99].ids == []
    back = {r.doc_id: r for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    assert [back[i].text for i in range(len(odd))] == odd and back[99].raw == b""
    assert bpe.digest(df.limit(0), PATH, PATTERN).count() == 0
    assert bpe.digest(documents(spark), PATH, PATTERN).count() == 12
    with pytest.raises(ValueError):
        bpe.digest(documents(spark).withColumnRenamed("doc_id", "n_tokens"), PATH, PATTERN, key="n_tokens")


def test_pieces_put_together():
    text = "ab cd  ef\n" * 3000
    assert "".join(bpe.pieces_of(text, 100)) == text and len(bpe.pieces_of(text, 100)) > 50
