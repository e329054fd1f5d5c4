import itertools
import random
import re

import numpy as np
import xxhash
from edge import documents
from folioforge.llm import simhash


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i + 1, len(fps)):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(fps))]


def test_against_all_pairs(spark, data):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, data).collect()}
    fps = [fingerprint(t) for _, t in docs]
    assert found == {k: (f"{f:016x}", docs[c][0]) for (k, _), f, c in zip(docs, fps, components(fps))}


def test_chains_and_dense_groups(spark):
    random.seed(5)
    center = random.getrandbits(64)
    fps = [center]
    for _ in range(250):  # a dense ball and chains that leave it
        x = random.choice(fps)
        for b in random.sample(range(64), random.randint(1, 4)):
            x ^= 1 << b
        fps.append(x)
    fps = list(dict.fromkeys([*fps, *(random.getrandbits(64) for _ in range(50)), 0, (1 << 64) - 1]))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for links in (simhash.fingerprint_links(df), simhash.fingerprint_links(df, key_bytes=4), simhash.fingerprint_links(df, block=16)):
        at = {f: i for i, f in enumerate(signed)}
        parent = list(range(len(fps)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for r in links.collect():
            assert (fps[at[r.src]] ^ fps[at[r.dst]]).bit_count() <= 4
            a, b = sorted((find(at[r.src]), find(at[r.dst])))
            parent[b] = a
        assert [find(i) for i in range(len(fps))] == components(fps)


def test_any_four_shared_bytes_meet():
    for width in (2, 3, 4):
        places = simhash.posting_places(4, width)
        assert all(any(set(p) <= set(x) for p in places) for x in itertools.combinations(range(8), 4))
    assert len(simhash.posting_places(4, 3)) == 20 and len(simhash.posting_places(4, 4)) == 70


def test_tally_of_shared_bytes():
    rng = np.random.default_rng(0)
    a, b = rng.integers(-(1 << 63), 1 << 63, (2, 500))
    b = np.where(rng.random(500) < 0.5, a ^ (rng.integers(0, 256, 500) << (8 * rng.integers(0, 8, 500))), b)
    want = [sum(x == y for x, y in zip(int(p).to_bytes(8, "little", signed=True), int(q).to_bytes(8, "little", signed=True))) for p, q in zip(a, b)]
    assert simhash.shared_bytes(a, b).tolist() == want
    assert simhash.linked(a, b, 4).tolist() == [((int(p) ^ int(q)) & (1 << 64) - 1).bit_count() <= 4 for p, q in zip(a, b)]


def test_lists_over_batches():
    import pyarrow as pa

    keys, values = np.array([1, 1, 2, 3, 3, 3, 4, 5, 5, 5, 5, 5, 5, 5, 6, 6]), np.arange(16)
    for cuts in ((0, 1, 4, 5, 7, 16), (0, 16), tuple(range(17)), (0, 9, 9, 12, 16)):
        batches = [pa.record_batch([pa.array(keys[a:b]), pa.array(values[a:b])], names=["k", "v"]) for a, b in zip(cuts, cuts[1:])]
        lists, blocks = [], []
        for found in simhash.posting_lists(batches, "k", "v", block=3):
            if isinstance(found[0], int):
                blocks.append((found[0], found[1], found[2].tolist()))
            else:
                lists += [found[0][s : s + n].tolist() for s, n in zip(found[1], found[2])]
        assert lists == [[0, 1], [3, 4, 5], [14, 15]] and [b[:2] for b in blocks] == [(5, i) for i in range(len(blocks))]
        assert [x for b in blocks for x in b[2]] == list(range(7, 14)) and max(len(b[2]) for b in blocks) <= 3


def test_edges(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == 1
    assert by[3].fp == by[4].fp == by[5].fp == 0 and by[5].component_id == 3
    assert by[None].component_id is None
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0
