"""Operator 3: personal data by weak supervision, in DataFrame functions only.

Patterns propose spans; three labelers (format, gazetteer, context) vote on each. Expectation-maximisation over the counts
of the votes estimates how reliable each labeler is, and a logistic span classifier learns the resulting beliefs from what
the labelers saw and from what they didn't: the proposing pattern, the span's neighbours, its length and its share of
digits. All of it goes by counts of such patterns, a table whose size is fixed. Spans of the base rules always stay; the
classifier decides on the others.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, functions as F

from folioforge.functions.text import pinned
from folioforge.plans.lineage import cut_lineage

#: Kinds of spans. The base rules know the first four.
KINDS = ("email", "ip", "card", "phone", "secret")
N_BASE = 4

#: What proposes spans: kind, pattern, and a cheap test that a text must pass first. The first four hold the base rules' spans,
#: written so that no position of a long run is tried twice: a match starts where a run starts, or where the last one ended.
LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
NAMED = """(?i:token|secret|key|passw(?:or)?d|pwd)["']{0,1} {0,1}[=:] {0,1}["']{0,1}"""
OPAQUE = "[A-Za-z0-9+/_-]"
PROPOSERS = (
    ("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "[0-9]\\.[0-9]"),
    ("card", r"[0-9](?:[ -]?[0-9])++", "[0-9]"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "\\+[0-9]"),
    ("email", rf"(?<!{LOCAL}){LOCAL}++ ?[(\[]at[)\]] ?{LABEL}++(?: ?(?:\.|[(\[]dot[)\]]) ?{LABEL}++)++", "[(\\[]at[)\\]]"),
    ("phone", r"(?<![0-9.+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", "[0-9]{3}[ .-][0-9]{4}"),
    ("secret", f"(?<={NAMED}){OPAQUE}{{8,}}+", """(?i)(?:token|secret|key|passw(?:or)?d|pwd)["']? ?[=:]"""),
    ("secret", f"(?<!{OPAQUE})(?<!{NAMED}){OPAQUE}{{20,}}+", f"{OPAQUE}{{20}}"),
)

#: Fixed lists of the gazetteer labeler: endings of e-mail domains; first digits of issuers; calling codes; first parts of
#: addresses that are not given to hosts; area codes of North America, which are written without a calling code.
DOMAIN_ENDS = "com|org|net|edu|gov|int|info|io|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|mx|ar"
ISSUERS = "3[4-7]|4|5[1-5]|2[2-7]|6"
CALLING_CODES = "1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
RESERVED = "0|22[4-9]|23[0-9]|24[0-9]|25[0-5]"
AREA_CODES = "(?!.11|37|96)[2-9][0-8][0-9]"
PLACEHOLDERS = "x+|changeme|password|placeholder|example|sample|undefined"

#: Of secrets without a name in front: how issuers begin theirs; what is more often a digest or an identifier; words and numbers joined
#: to a path or name; fillings. Fixed values.
ISSUED = "gh[opsu]_|github_pat_|glpat-|sk-|[sr]k_live_|AKIA|ASIA|AIza|xox[abprs]-|ya29|eyJ"
DIGESTS = "(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"
JOINED = "[A-Za-z]*[0-9]*(?:[/_+-][A-Za-z]*[0-9]*)*$"
FILLED = r".*(.)\1{5}"

#: What tells such a secret from words: bits a character, and characters for each change between letters and digits, at most.
LEAST_BITS, CHANGE_CHARS = 3.0, 8

#: Cues of the context labeler around a span: for, and against.
CUES = {
    "email": (r"mail|contact|write|reach", r"example only|regex|pattern"),
    "ip": (r"\bip\b|host|server|address|from", r"version|release|section|v$"),
    "card": (r"card|visa|credit|payment|pay\b", r"isbn|order|serial|tracking|id:? *$"),
    "phone": (r"phone|call|tel|mobile|fax", r"isbn|order|serial|version"),
    "secret": (r"token|secret|passw|pwd|api|access|bearer|\bauth|credential|\blog ?in\b", r"primary|foreign|example|sample|public|commit|checksum|digest|revision|\buuid|\bsha-?[0-9]|\bmd5"),
}

#: Characters before and after a span that count as its context; those before reach back over one earlier match.
BEFORE_CHARS, AFTER_CHARS = 40, 20

#: Classes of the characters next to a span, by pattern; a text's edge is 0, any other character the last.
NEIGHBOURS = (r"[A-Za-z]", r"[0-9]", r"\s", r"[\"'()\[\]{}<>=:]")

#: Least probability of a span that isn't the base rules'.
LEAST_PROBABILITY = 0.9

#: What the classifier sees of a span, and how many values each has. The first four also by kind.
LEVELS = {"format": 2, "gazetteer": 2, "context": 3, "size": 4, "how": len(PROPOSERS), "left": len(NEIGHBOURS) + 2, "right": len(NEIGHBOURS) + 2, "digits": 4}
BY_KIND = ("format", "gazetteer", "context", "size")

_SPANS = f"array<struct<kind:int,start:int,end:int,base:boolean,{','.join(f'{c}:int' for c in LEVELS)}>>"

#: Steps of a doubling or a binary search over an array.
_POWERS = [1 << i for i in range(31)]


def _steps(size: Column, down: bool = False) -> Column:
    """1, 2, 4, ... up to the last power below ``size``; or down to 1 from the last one that isn't above it."""
    n = F.coalesce(F.ceil(F.log2(F.greatest(F.lit(1), size + F.lit(int(down))))), F.lit(0)).cast("int")
    up = F.slice(F.array(*map(F.lit, _POWERS)), F.lit(1), n)
    return F.reverse(up) if down else up


def running_sums(a: str) -> Column:
    """Running sums of the array column ``a`` by doubling: n log n for n elements, where a fold that appends would be quadratic."""
    return F.aggregate(_steps(F.size(a)), F.col(a), lambda acc, step: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step), F.lit(0))))


def _starting_before(spans: str, end: Column) -> Column:
    """How many of the spans, sorted by start, start before ``end``: a binary search."""
    below = lambda n, step: F.coalesce(F.get(spans, n + step - 1)["start"] < end, F.lit(False))
    return F.aggregate(_steps(F.size(spans), down=True), F.lit(0), lambda n, step: F.when(below(n, step), n + step).otherwise(n))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _base(i: int, hit: Column) -> Column:
    """Whether a proposed span is one of the base rules'."""
    n = F.length(_digits(hit))
    if i == 1:
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if i == 2:
        return n.between(13, 19) & F.call_function("luhn_check", _digits(hit))
    if i == 3:
        return n.between(9, 15)
    return F.lit(i == 0)


def _candidate(i: int, hit: Column) -> Column:
    """Whether a proposed span goes to the labelers at all."""
    if i == 7:
        return hit.rlike("[0-9]") & hit.rlike("[A-Za-z]")
    return F.length(_digits(hit)).between(13, 19) if i == 2 else F.lit(True) if i > 3 else _base(i, hit)


def bits_a_character(c: Column) -> Column:
    """Shannon's entropy of a string's characters."""
    n = F.length(c).cast("double")
    each = lambda total, x: total + (n - F.length(F.replace(c, x, F.lit("")))) * F.log2(n - F.length(F.replace(c, x, F.lit(""))))
    return F.log2(n) - F.aggregate(F.array_distinct(F.split(c, "")), F.lit(0.0), each) / n


def _format(i: int, hit: Column) -> Column:
    """Whether a span has the form of what its own proposer looks for; whether the base rules hold it doesn't count. A card's form
    is its check digit; an obfuscated address has a closed bracket and ends in letters; a plain number has alike or bracketed parts; a
    secret mixes letters and digits; one without a name changes between them often and is spread over many characters."""
    if i == 7:
        changes = F.size(F.regexp_extract_all(hit, F.lit("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]"), F.lit(0)))
        return (changes * CHANGE_CHARS >= F.length(hit)) & (bits_a_character(hit) >= LEAST_BITS)
    if i == 6:
        return hit.rlike(r"^(?=.*[0-9])(?=.*[A-Za-z]).{16}")
    if i == 4:
        return hit.rlike(r"(?:\(at\)|\[at\]).*[A-Za-z]{2}$")
    if i == 5:
        return hit.rlike(r"^(?:\([0-9]{3}\)[ .-][2-9][0-9]{2}[ .-]|[0-9]{3}([ .-])[2-9][0-9]{2}\1)[0-9]{4}$")
    return _base(i, hit)  # the first four look for what the base rules describe


def _gazetteer(i: int, hit: Column) -> Column:
    secret = ~hit.rlike(rf"(?i)^(?:{PLACEHOLDERS})")
    known = {
        "email": hit.rlike(rf"(?i)(?:\.|[)\]]) ?(?:{DOMAIN_ENDS})$"),
        "ip": ~hit.rlike(rf"^0*(?:{RESERVED})\."),
        "card": _digits(hit).rlike(f"^(?:{ISSUERS})"),
        "phone": hit.rlike(rf"^(?:\+(?:{CALLING_CODES})|\(?{AREA_CODES})"),
        "secret": secret & (hit.rlike(f"^(?:{ISSUED})") | ~hit.rlike(f"^(?:{DIGESTS}|{JOINED}|{FILLED})")) if i == 7 else secret,
    }[PROPOSERS[i][0]]
    return F.when(known, 1).otherwise(-1)


def _context(kind: str, before: Column, after: Column) -> Column:
    around = F.lower(F.concat_ws("\n", before, after))
    return F.when(around.rlike(CUES[kind][0]), 1).when(around.rlike(CUES[kind][1]), -1).otherwise(0)


def _neighbour(c: Column) -> Column:
    found = F.when(c == "", 0)
    for n, group in enumerate(NEIGHBOURS):
        found = found.when(c.rlike(group), n + 1)
    return found.otherwise(len(NEIGHBOURS) + 1)


def labelled_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, spans)``: all candidates of each row with the votes on them; places in code points, end exclusive.

    A text is split once for each proposer; what a span's place and context need comes from the pieces next to it, so the work is
    in proportion to the text (and n log n in the number of matches).
    """
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    split, size = {}, {}
    for i, (_, pattern, test) in enumerate(PROPOSERS):
        due = F.col("text").contains(test) if test == "@" else F.col("text").rlike(test)
        split[f"gaps{i}"] = F.when(due, F.split("text", pattern, -1))
        split[f"found{i}"] = F.when(due, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        size[f"size{i}"] = F.zip_with(F.slice(f"gaps{i}", F.lit(1), F.size(f"found{i}")), f"found{i}", lambda g, h: F.length(g) + F.length(h))
    rows = pinned(pinned(rows, **split).drop("text"), **size)
    rows = pinned(rows, **{f"ends{i}": running_sums(f"size{i}") for i in range(len(PROPOSERS))})
    parts = []
    for i, (kind, _, _) in enumerate(PROPOSERS):

        def vote(x):
            hit, at = x["hit"], x["at"]
            end = F.get(f"ends{i}", at)
            earlier = F.when(at > 0, F.concat(F.right(F.get(f"gaps{i}", at - 1), F.lit(BEFORE_CHARS)), F.get(f"found{i}", at - 1))).otherwise("")
            near = F.right(F.get(f"gaps{i}", at), F.lit(BEFORE_CHARS))
            before = F.right(F.concat(F.right(earlier, F.lit(BEFORE_CHARS)), near), F.lit(BEFORE_CHARS))
            after = F.left(F.get(f"gaps{i}", at + 1), F.lit(AFTER_CHARS))
            share = F.length(_digits(hit)) / F.length(hit)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"), _base(i, hit).alias("base"),
                F.when(_format(i, hit), 1).otherwise(-1).alias("format"), _gazetteer(i, hit).alias("gazetteer"), _context(kind, before, after).alias("context"),
                F.least(F.lit(3), F.length(hit) / 8).cast("int").alias("size"), F.lit(i).alias("how"),
                _neighbour(F.right(before, F.lit(1))).alias("left"), _neighbour(F.left(after, F.lit(1))).alias("right"),
                F.when(share == 0, 0).when(share < 0.5, 1).when(share < 1, 2).otherwise(3).alias("digits"),
            )

        placed = F.transform(f"found{i}", lambda hit, at: F.struct(hit.alias("hit"), at.alias("at")))
        wanted = F.filter(placed, lambda x: _candidate(i, x["hit"]))
        parts.append(F.coalesce(F.transform(wanted, vote).cast(_SPANS), F.array().cast(_SPANS)))
    return rows.select(F.col("key").alias(key), F.concat(*parts).alias("spans"))


Pattern = tuple[int, ...]  # kind, three votes, then the other LEVELS in order


def vote_counts(spans: DataFrame) -> dict[Pattern, int]:
    """How many spans have each pattern of kind, votes and other features: a table bounded by the product of their levels, of which
    real text shows some hundreds."""
    names = ("kind", *LEVELS)
    one = spans.select(F.explode_outer("spans").alias("s")).select("s.*").groupBy(*names)
    return {tuple(r)[:-1]: r["n"] for r in one.agg(F.count("*").alias("n")).collect() if r["kind"] is not None}


def beliefs(counts: dict[Pattern, int], rounds: int = 60) -> tuple[dict[Pattern, float], dict[tuple[int, int], float]]:
    """Expectation-maximisation, for each kind by itself: the probability that a span of some kind and votes is personal data, and
    each labeler's estimated accuracy where it votes. Labelers are independent given the truth; counts start at 1."""
    belief, accuracy, votes = {}, {}, {}
    for p, n in counts.items():
        votes[p[:4]] = votes.get(p[:4], 0) + n
    for kind in {p[0] for p in votes}:
        own = {p: n for p, n in votes.items() if p[0] == kind}
        prior, vote = 0.7, [[{1: 0.7, 0: 0.2, -1: 0.1}, {1: 0.15, 0: 0.35, -1: 0.5}] for _ in range(3)]
        for _ in range(rounds):
            q = {}
            for p in own:
                yes, no = log(prior), log(1 - prior)
                for j in range(3):
                    yes += log(vote[j][0][p[1 + j]])
                    no += log(vote[j][1][p[1 + j]])
                q[p] = 1 / (1 + exp(min(50, no - yes)))
            weight = sum(n * q[p] for p, n in own.items())
            total = sum(own.values())
            prior = (weight + 1) / (total + 2)
            for j in range(3):
                for c in (0, 1):
                    at = {v: 1 + sum(n * (q[p] if c == 0 else 1 - q[p]) for p, n in own.items() if p[1 + j] == v) for v in (1, 0, -1)}
                    vote[j][c] = {v: x / sum(at.values()) for v, x in at.items()}
        belief |= q
        for j in range(3):
            right = prior * vote[j][0][1] + (1 - prior) * vote[j][1][-1]
            wrong = prior * vote[j][0][-1] + (1 - prior) * vote[j][1][1]
            accuracy[kind, j] = right / (right + wrong)
    return belief, accuracy


def _offsets() -> dict[str, int]:
    found, n = {}, len(KINDS)
    for name, levels in LEVELS.items():
        found[name], n = n, n + levels * (len(KINDS) if name in BY_KIND else 1)
    return found | {"": n}


#: Where each feature's weights start; the first are the kinds'.
OFFSETS = _offsets()


def features(p: Pattern) -> list[int]:
    """Which of the classifier's yes-or-no features a pattern has: its kind, and one value of each of LEVELS."""
    at = [p[0]]
    for (name, levels), v in zip(LEVELS.items(), p[1:]):
        v = {"format": (v + 1) // 2, "gazetteer": (v + 1) // 2, "context": v + 1}.get(name, v)
        at.append(OFFSETS[name] + v + (p[0] * levels if name in BY_KIND else 0))
    return at


def train_classifier(counts: dict[Pattern, int], belief: dict[Pattern, float], steps: int = 400, rate: float = 1.0) -> list[float]:
    """Weights of a logistic classifier that fits the beliefs, each pattern weighing as the logarithm of its count."""
    rows = [(features(p), belief[p[:4]], log(1 + n)) for p, n in sorted(counts.items())]
    w = [0.0] * OFFSETS[""]
    total = sum(r[2] for r in rows) or 1.0
    for _ in range(steps):
        g = [0.001 * x for x in w]
        for at, y, n in rows:
            z = sum(w[k] for k in at)
            d = n * (1 / (1 + exp(-max(-50, min(50, z)))) - y) / total
            for k in at:
                g[k] += d
        w = [a - rate * b for a, b in zip(w, g)]
    return w


def _probability(x: Column, w: list[float]) -> Column:
    table = F.array(*map(F.lit, w))
    z = F.get(table, x["kind"])
    for name, levels in LEVELS.items():
        v = {"format": F.floor((x["format"] + 1) / 2), "gazetteer": F.floor((x["gazetteer"] + 1) / 2), "context": x["context"] + 1}.get(name, x[name])
        z = z + F.get(table, (F.lit(OFFSETS[name]) + v + (x["kind"] * levels if name in BY_KIND else F.lit(0))).cast("int"))
    return 1 / (1 + F.exp(-z))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST_PROBABILITY) -> DataFrame:
    """``(key, spans)`` of every row: array<struct(kind, start, end, base, probability)>, by kind, then place.

    Base spans always stay. Of the others, those stay that the classifier gives at least ``least`` and that overlap no base span.
    Added spans of one kind don't overlap: one proposer adds it, or, as with secrets, two of which one takes only what has a name in front
    and the other only what has none. Those of two kinds may share a place, and both are reported, each found by its own labelers, so
    that what either covers is known. A null, empty or clean text has no spans. Repeated rows stay; extra columns are left out; an empty table gives an empty
    result. There is no shuffle of texts or spans: only counts of vote patterns meet.
    """
    found = cut_lineage(labelled_spans(docs, key, text))
    counts = vote_counts(found)
    belief, _ = beliefs(counts)
    w = train_classifier(counts, belief)
    own = {f"base{k}": F.filter("spans", lambda x: x["base"] & (x["kind"] == k)) for k in range(N_BASE)}  # each sorted by place, without overlap
    found = pinned(found, **own)

    def free(x):
        last = lambda k: F.get(f"base{k}", _starting_before(f"base{k}", x["end"]) - 1)
        return ~F.coalesce(*[F.when(last(k)["end"] > x["start"], True) for k in range(N_BASE)], F.lit(False))

    more = F.filter("spans", lambda x: ~x["base"] & (_probability(x, w) >= least) & free(x))
    found = pinned(found, more=more)
    out = F.transform(
        F.concat(*[f"base{k}" for k in range(N_BASE)], "more"),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"), _probability(x, w).alias("probability")),
    )
    return pinned(found.select(key, out.alias("_out")), spans=F.sort_array("_out")).drop("_out")


def _written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    one = lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """Operator 3 over the whole ``documents`` table."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["base"])
    n = [F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:N_BASE])]
    return found.select("doc_id", *n, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
