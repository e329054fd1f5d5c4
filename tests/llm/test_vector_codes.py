"""Operator 12 against plain loops, and its search against all distances."""

from hashlib import sha256

import numpy as np
import pytest
from conftest import same
from folioforge.llm import vector_codes as vc


def plain(rows, rounds=4, entries=256):
    """(key, label, vector) rows of one length, by the definition."""
    kept = [(k, lab, [int(np.floor(1024 * float(x))) for x in v]) for k, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = len(kept[0][2])
    cuts = [(i * dim // 4, (i + 1) * dim // 4) for i in range(4)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[r[2][a:b] for r in first] for a, b in cuts]
    far = lambda x, c: sum((i - j) ** 2 for i, j in zip(x, c))

    def own(part, book):
        return min((far(part, c), i) for i, c in enumerate(book))

    for _ in range(rounds):
        for p, (a, b) in enumerate(cuts):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(own(v[a:b], books[p])[1], []).append(v[a:b])
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g)]
    out, by_label = [], {}
    for k, lab, v in kept:
        best = [own(v[a:b], books[p]) for p, (a, b) in enumerate(cuts)]
        error = sum(d for d, _ in best)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((k, lab, "".join(f"{i:02x}" for _, i in best), error))
    digest = sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    return sorted((repr((k, code, error, by_label[lab], digest)) for k, lab, code, error in out))


def found(df):
    return sorted(repr(tuple(r)) for r in df.collect())


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error int"


def frame(spark, rows):
    return spark.createDataFrame([(k, v, lab, "x", 1) for k, lab, v in rows], SCHEMA)


def test_oracle(spark, duck, data):
    same(vc.op12_vector_codes, vc.SQL, spark, duck, data)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i % 3) if i % 4 else None, [float(x) for x in np.float32(rng.normal(0, 1, 8))]) for i in range(60)]
    rows += [(100, 1, None), (101, 1, [1.0] * 7 + [float("nan")]), (102, 1, [float("inf")] + [0.0] * 7), (103, 1, [None] + [0.0] * 7)]
    rows += [(None, 2, [0.5] * 8), (3, 2, [0.5] * 8), (3, 2, [0.5] * 8), (4, None, [-0.0001] * 8), (5, 1, [0.0] * 8)]
    kept = frame(spark, rows)
    assert found(vc.compress(kept, entries=16).drop("more")) == plain(rows, entries=16)
    assert found(vc.compress(kept.repartition(5))) == plain(rows)
    assert vc.compress(kept).columns == ["vec_id", *vc.RESULTS]


def test_lengths_are_tables_of_their_own(spark):
    short = [(i, i % 2, [i / 7, 1.0, -i / 3, 2.0]) for i in range(9)]
    long = [(i, 5, [float(i)] * 8) for i in range(9)]
    odd = [(50, 9, [1.0, 2.0, 3.0, 4.0, 5.0]), (51, 9, [])]
    got = {r.vec_id: r for r in vc.compress(frame(spark, odd)).collect()}
    assert got[50].error == 0 and got[51].code == "00000000" and got[51].error == 0
    assert found(vc.compress(frame(spark, short + long))) == sorted(plain(short) + plain(long))


def test_large_components(spark):
    rows = [(1, 0, [3.0e38] * 4), (2, 0, [-3.0e38] * 4), (3, 0, [0.0] * 4)]
    assert vc.compress(frame(spark, rows), entries=1).count() == 3


def test_empty(spark):
    none = vc.compress(frame(spark, []))
    assert none.count() == 0 and dict(none.dtypes) == {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"}
    with pytest.raises(ValueError):
        vc.compress(frame(spark, []), key="error")


@pytest.mark.parametrize("dim,spread", [(1, 5), (3, 2), (16, 1024), (16, 3), (64, 2**20)])
def test_search_is_exact_with_ties(dim, spread):
    rng = np.random.default_rng(dim + spread)
    x, book = rng.integers(-spread, spread + 1, (500, dim)), rng.integers(-spread, spread + 1, (256, dim))
    book[7] = book[3]
    far = ((x[:, None] - book) ** 2).sum(2)
    index, best = vc.nearest(x, book)
    assert (index == far.argmin(1)).all() and (best == far.min(1)).all()
