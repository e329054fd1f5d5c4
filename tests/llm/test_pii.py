import hashlib
import itertools
import math
import random
import re
import string
import time

import pytest
from edge import documents
from folioforge.llm import pii
from pyspark.sql import functions as F

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v * 2 > 9) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def holds(kind, hit):
    d = re.sub("[^0-9]", "", hit)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in hit.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(r, text or "") if holds(k, m[0])] for k, r in RULES.items()}


def check(docs, rows):
    for k, t in docs.items():
        b, r = base(t), rows[k]
        written = ",".join(f"{kind}:{s}:{e}" for kind in RULES for s, e in b[kind])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(v) for v in b.values()]
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))


def test_base_spans(spark, data):
    check({r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}, {r.doc_id: r for r in pii.op3_pii(spark, data).collect()})


def test_odd_texts(spark, tmp_path):
    odd = [
        "a@b@c.d", "x@y.z_q@r.s", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "4111 1111-1111 1111", "+1 (212) 555-1234 +44 20 7946 0958", "aé@b.co", "😀 a@b.co 😀", "a@b..c",
        "+" * 5 + "1234567890", "00001.02.3.4", "5", "5 5", "", "4111111111111111a@b.co", ".@-.-", "1.2.3.4@5.6", "a@" + ".b" * 6000 + " a@b" + ".c" * 6000, "1 " * 20000, None,
    ]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    check(dict(enumerate(odd)), {r.doc_id: r for r in pii.op3_pii(spark, str(tmp_path)).collect()})


def test_beliefs_find_the_reliable_labeler():
    rest = (1, 0, 3, 3, 1)
    votes = {(0, 1, 1, 1): 50, (0, 1, 1, 0): 40, (0, 1, -1, 0): 5, (0, -1, -1, 0): 40, (0, -1, -1, -1): 20, (0, -1, 1, 1): 6}
    counts = {(*p, *rest): n for p, n in votes.items()}
    belief, accuracy = pii.beliefs(counts)
    assert belief[0, 1, 1, 1] > 0.95 > 0.05 > belief[0, -1, -1, -1] and accuracy[0, 0] > 0.8
    w = pii.train_classifier(counts, belief)
    p = lambda x: sum(w[k] for k in pii.features(x))
    assert p((0, 1, 1, 1, *rest)) > 0 > p((0, -1, -1, -1, *rest))
    assert pii.beliefs({}) == ({}, {})


def test_classifier_sees_more_than_the_votes():
    counts = {(3, 1, 1, 0, 1, 5, 3, 3, 2): 100, (3, 1, -1, -1, 1, 5, 5, 5, 2): 100, (3, 1, 1, 1, 1, 5, 3, 3, 2): 50, (3, -1, -1, -1, 1, 5, 5, 5, 2): 50, (3, 1, -1, 0, 1, 5, 3, 3, 2): 1, (3, 1, -1, 0, 1, 5, 5, 5, 2): 1}
    belief, _ = pii.beliefs(counts)
    w = pii.train_classifier(counts, belief)
    p = lambda x: sum(w[k] for k in pii.features(x))
    assert p((3, 1, -1, 0, 1, 5, 3, 3, 2)) > p((3, 1, -1, 0, 1, 5, 5, 5, 2)) + 0.5  # the same votes, other neighbours


def test_features_are_the_column_alike(spark):
    rows = [(0, 1, -1, 0, 1, 4, 3, 2, 1), (4, -1, 1, 1, 3, 6, 0, 5, 2), (2, 1, 1, -1, 0, 2, 1, 1, 3)]
    w = [((i * 37) % 11 - 5) / 7 for i in range(pii.OFFSETS[""])]
    names = ("kind", *pii.LEVELS)
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    got = df.select(*names, pii._probability({n: F.col(n) for n in names}, w).alias("p")).collect()
    for r in got:
        assert abs(r.p - 1 / (1 + math.exp(-sum(w[k] for k in pii.features(tuple(r)[:-1]))))) < 1e-9


def test_plain_numbers_and_obfuscated_addresses_are_found(spark):
    rows = [(i, f"write to jane.doe{i}@mail.org or call +1 212 555 12{i:02d}") for i in range(60)]
    rows += [(100 + i, f"please call (212) 555-12{i:02d} or phone 646-555-13{i:02d}") for i in range(5)]
    rows += [(200 + i, f"contact mail: jane.doe{i} (at) mail (dot) org") for i in range(5)]
    rows += [(400 + i, f'api token = "{hashlib.sha1(bytes([i])).hexdigest()}" and key = "placeholder{i}"') for i in range(5)]
    rows += [(300 + i, f"serial 911-155.12{i:02d} or 111-055-12{i:02d}") for i in range(5)]
    text = dict(rows)
    found = {r.doc_id: [text[r.doc_id][s.start : s.end] for s in r.spans if not s.base] for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == [] for i in range(60))
    for i in range(5):
        assert found[100 + i] == [f"(212) 555-12{i:02d}", f"646-555-13{i:02d}"]
        assert found[200 + i] == [f"jane.doe{i} (at) mail (dot) org"]
        assert found[300 + i] == []
        assert found[400 + i] == [hashlib.sha1(bytes([i])).hexdigest()]


def planted():
    """Secrets without a name in front, and what looks like them: ``(text, secret or None)``, sixty of each."""
    rng = random.Random(7)
    word = lambda n, of: "".join(rng.choice(of) for _ in range(n))
    mixed, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    made = {
        "bearer": lambda: word(40, mixed), "issued": lambda: "ghp_" + word(36, mixed), "hex": lambda: word(48, hexes), "slashed": lambda: word(44, mixed + "+/"),
        "slug": lambda: "/".join(["posts", "2024", *[rng.choice(["river", "market", "history", "winter"]) + "-notes" for _ in range(3)]]), "commit": lambda: word(40, hexes), "uuid": lambda: "-".join(word(n, hexes) for n in (8, 4, 4, 4, 12)),
        "padding": lambda: "aaaaaaaaaaaaaaaaaaaaaaa1" + word(1, hexes), "name": lambda: "internationalization_of_the_library_v2",
    }
    lead = {"commit": "fixed in commit ", "uuid": "see uuid ", "slug": "read ", "padding": "then ", "name": "call "}
    return [(f"{lead.get(k, 'log in with ')}{s} today", s if k not in lead else None) for k, make in made.items() for s in (make() for _ in range(60))]


def test_secrets_without_a_name(spark):
    rows = planted()
    rows += [(f'api token = "{hashlib.sha1(bytes([i])).hexdigest()}" here', hashlib.sha1(bytes([i])).hexdigest()) for i in range(60)]
    found = pii.detect(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    got = {r.doc_id: [rows[r.doc_id][0][s.start : s.end] for s in r.spans] for r in found}
    secrets = [i for i, (_, s) in enumerate(rows) if s]
    assert sum(got[i] == [rows[i][1]] for i in secrets) >= 0.95 * len(secrets)
    assert sum(got[i] != [] for i in range(len(rows)) if not rows[i][1]) == 0


def test_bits_a_character(spark):
    texts = ["", "a", "aaaa", "ab", "aabb", "abcd", "0123456789abcdef", "aab", "\U0001f600b"]
    entropy = lambda s: -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s))
    for r in spark.createDataFrame([(t,) for t in texts if t], "t string").select("t", pii.bits_a_character(F.col("t")).alias("h")).collect():
        assert abs(r.h - entropy(r.t)) < 1e-9


def test_many_spans_in_one_text(spark, tmp_path):
    rows = [(1, "a@b.co " * 50_000), (2, "12a ," * 200_000), (3, "call (212) 555-1234 or +1 212 555 1234 " * 20_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    began = time.time()
    found = {r.doc_id: r for r in pii.detect(spark.read.parquet(str(tmp_path / "d"))).where("size(spans) >= 0").collect()}
    assert time.time() - began < 90
    assert [(s.start, s.end) for s in found[1].spans] == [(7 * i, 7 * i + 6) for i in range(50_000)]
    assert found[2].spans == [] and sum(s.base for s in found[3].spans) == 20_000


def test_places_by_doubling_and_search(spark):
    a = [[], [5], [3, 0, 4], list(range(100)), [7] * 64]
    rows = spark.createDataFrame([(x,) for x in a], "a array<int>").select(pii.running_sums("a").alias("s")).collect()
    assert [r.s for r in rows] == [list(itertools.accumulate(x)) for x in a]
    starts = spark.createDataFrame([([(s,) for s in x], e) for x in ([], [1], [1, 4, 9], list(range(0, 200, 3))) for e in (0, 1, 2, 5, 100, 300)], "b array<struct<start:int>>, e int")
    assert all(r.n == sum(x.start < r.e for x in r.b) for r in starts.select("b", "e", pii._starting_before("b", F.col("e")).alias("n")).collect())


def test_edges_and_plan(spark, data):
    rows = pii.detect(documents(spark)).collect()
    assert len(rows) == 12 and all(r.spans == [] for r in rows if r.doc_id != 7)
    assert pii.detect(documents(spark).limit(0)).count() == 0
    assert not re.search("Python|Arrow|Pandas", pii.op3_pii(spark, data)._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("kind", range(pii.N_BASE))
def test_kinds_have_rules(kind):
    assert pii.PROPOSERS[kind][0] == pii.KINDS[kind]


def test_added_spans_of_two_kinds_may_share_a_place(spark):
    rows = [(i, f"please call (212) 555-12{i:02d} or phone 646-555-13{i:02d}") for i in range(20)] + [(50 + i, f'api token = "{hashlib.sha1(bytes([i])).hexdigest()}"') for i in range(20)]
    rows += [(100, "phone key=646-555-1399 call"), (101, "phone key=646-555-1398 call")]
    found = pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in found:
        for a, b in itertools.combinations(r.spans, 2):
            assert a.kind != b.kind or a.end <= b.start or b.end <= a.start
    both = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in found if r.doc_id >= 100}
    assert all((pii.KINDS.index("phone"), 10, 22) in v and len(v) == len(set(v)) for v in both.values())
