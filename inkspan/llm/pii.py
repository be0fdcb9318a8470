r"""Personal data: candidates by generators, boosted trees over format and context, in DataFrame functions only.

Base spans (email, ip, card, phone) are found by linear-time forms of their patterns (possessive where nothing can be
given back; a run of name characters is entered at its start only, or where the last match ended) and always stay.
Generators with more recall propose further, overlapping spans: addresses with `[at]`, `(dot)` and the like,
dotted quads with bracketed dots, runs of digits with separators, and long strings of letters and digits (keys and tokens, kind
secret). Each candidate gets format features (lengths, digit and separator counts, checksum and octet tests) and context features
(words of contact, payment or keys before it, an assignment, what stands on either side), and gradient-boosted trees score it.

The trees are fitted on two sets of labelled candidates. One is a bounded sample of the corpus: of at most SAMPLE documents
(distinct ones, those with the least hashes) at most CANDIDATES candidates; positive where a candidate passes the base test of its
kind, is a formatted number of a phone's length after a word of calling, 13 to 19 digits whose checksum holds after a word of cards,
or a secret that is assigned to a word for one; negative where the base pattern of its own kind (or, for a number, that of a dotted
quad) fits the whole of it and its test fails, where it is a date, where a bare number has no such context, or where a long string
has no word for a secret before it. All else has no label. The other is a few hundred made texts (seeds), so that each kind has
examples of both labels whatever the corpus holds. The threshold is calibrated on a third of all that the trees did not see: the
least score from which on PRECISION of the candidates are positive, counted with one positive and one negative more; if none reaches
that, the trees' own log-odds of PRECISION. Candidates that overlap a base span are dropped; others may overlap each other. All of
this happens in each document's row; nothing is shuffled. Offsets are prefix sums in n log n steps, and overlaps are found by binary
search, so a text with very many spans takes little more than its length.

Null text: empty, no spans. Null doc_id: kept. Repeated rows: alike. Empty table: empty result. Other columns do not
matter. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import least_hashes
from .quality import let

#: Documents and candidates that are labelled at most.
SAMPLE, CANDIDATES = 4000, 20_000
PRECISION = 0.98
CONTEXT = 24
KINDS = ("email", "ip", "card", "phone")

_NAME = r"[A-Za-z0-9._%+-]"
_AT, _DOT = r"(?:@|\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?)", r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?)"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": rf"(?:\G|(?<!{_NAME})){_NAME}++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])",
    "number": r"(?<![0-9A-Za-z])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,24}+(?![0-9A-Za-z])",
    "secret": r"(?<![A-Za-z0-9_+=-])(?=[A-Za-z_+=-]*+[0-9])(?=[0-9_+=-]*+[A-Za-z])[A-Za-z0-9_+=-]{16,}+",
}
#: What a text must hold for a pattern to fit; looked for first because it is much cheaper.
NEEDS = {"email": "[@\\[({]", "ip": "[0-9]", "card": "[0-9]", "phone": "\\+", "number": "[0-9]", "secret": "[0-9]"}
#: Words of contact, payment and network before a candidate.
WORDS = r"(?i)(?:mail|contact|call|phone|tel|fax|mobile|cell|sms|whatsapp|card|visa|konto|iban|account|cvv|ip|host|addr|server|kontakt|correo|courriel|appel)"
#: Words of calling and of cards, and dates, for the labels of numbers that are no base spans.
CALLS = r"(?i)(?:call|phone|tel|fax|mobile|cell|sms|whatsapp|appel)"
CARDS = r"(?i)(?:card|visa|cvv)"
#: Words for a secret, and one to which something is assigned, before a candidate.
SECRETS = r"(?i)(?:token|secret|passw|passphrase|pwd|credential|bearer|api.?key|access.?key|private.?key)"
ASSIGNED = r"[:=]>?[\x20\"']{0,3}$"
DATE = r"^(?:(?:19|20)[0-9]{2}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2(?:19|20)[0-9]{2})(?![0-9])"
SPAN = "array<struct<kind:string,start:int,end:int,s:string,before:string,after:string>>"
FEATURES = ("chars", "digits", "letters", "gaps", "dots", "at", "plus", "brackets", "luhn", "octets", "hex", "word", "secret", "assigned", "open", "closed", "like_email", "like_ip", "like_card", "like_secret")


def running(values: Column, op) -> Column:
    """The array's running totals under op, an associative function: each step doubles how far back an element looks."""

    def step(acc: Column, k: Column) -> Column:
        return let(F.pow(F.lit(2), k).cast("int"), lambda d: F.transform(acc, lambda x, i: F.when(i >= d, op(F.get(acc, i - d), x)).otherwise(x)))

    return F.when(F.size(values) <= 1, values).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1), values, step))


def find(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """All leftmost matches that do not overlap, as SPAN. Offsets are sums of the lengths of matches and gaps."""
    none = F.array().cast(SPAN)

    def place(m: Column, gaps: Column) -> Column:
        ends = running(F.transform(m, lambda x, i: F.length(gaps[i]) + F.length(x)), lambda a, b: a + b)
        one = lambda e: lambda x, i: F.struct(F.lit(kind).alias("kind"), (e[i] - F.length(x)).alias("start"), e[i].alias("end"), x.alias("s"), F.right(gaps[i], F.lit(CONTEXT)).alias("before"), F.left(gaps[i + 1], F.lit(2)).alias("after"))
        return let(ends, lambda e: F.transform(m, one(e))).cast(SPAN)

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, none).otherwise(let(F.split(text, pattern, -1), lambda g: place(m, g))))
    return F.when(text.rlike(needs), found).otherwise(none)


def apart(spans: Column, base: Column) -> Column:
    """Those spans that overlap none of base: of the base spans that start before a span's end, which are counted by binary
    search in their order, none reaches behind its start."""
    places = F.array_sort(F.transform(base, lambda y: F.struct(y["start"].alias("start"), y["end"].alias("end"))))

    def below(b: Column, end: Column) -> Column:
        """How many of b start before end."""
        n = F.size(b)
        bits = F.sequence(F.ceil(F.log2(n + 1)).cast("int") - 1, F.lit(0), F.lit(-1))
        step = lambda acc, k: let(acc + F.pow(F.lit(2), k).cast("int"), lambda to: F.when((to <= n) & (F.get(b, to - 1)["start"] < end), to).otherwise(acc))
        return F.aggregate(bits, F.lit(0), step)

    def free_of(b: Column) -> Column:
        reach = running(F.transform(b, lambda y: y["end"]), lambda x, y: F.greatest(x, y))
        return let(reach, lambda r: F.filter(spans, lambda x: let(below(b, x["end"]), lambda k: (k == 0) | (F.get(r, k - 1) <= x["start"]))))

    return F.when(F.size(base) == 0, spans).otherwise(let(places, free_of))


def luhn(digits: Column) -> Column:
    """The checksum test over a string of digits."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, r"[^0-9]", "")


def octets_ok(s: Column) -> Column:
    return s.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}")


def passes(kind: str, s: Column) -> Column:
    """The test that a base match must pass."""
    if kind == "ip":
        return octets_ok(s)
    if kind == "card":
        return let(digits_of(s), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(s)).between(8, 15)
    return F.lit(True)


def _passing(kind: str):
    return lambda x: passes(kind, x["s"])


def _failing(kind: str):
    if kind == "card":  # one of 13 to 15 digits fails by its checksum only
        return lambda x: let(digits_of(x["s"]), lambda d: F.when(F.length(d).between(13, 19), ~luhn(d)).otherwise(F.lit(True)))
    return lambda x: ~passes(kind, x["s"])


def base_spans(text: Column) -> dict[str, Column]:
    return {k: F.filter(find(text, k, PATTERNS[k], NEEDS[k]), _passing(k)) for k in KINDS}


def candidates(text: Column) -> Column:
    """Spans of all generators. A number's kind is card from 13 digits on, else phone."""
    number = F.transform(
        find(text, "number", GENERATORS["number"], NEEDS["number"]),
        lambda x: F.struct(F.when(F.length(digits_of(x["s"])) >= 13, "card").otherwise("phone").alias("kind"), *[x[c].alias(c) for c in ("start", "end", "s", "before", "after")]),
    ).cast(SPAN)
    return F.concat(*[find(text, k, GENERATORS[k], NEEDS[k]) for k in ("email", "ip")], number, find(text, "secret", GENERATORS["secret"], NEEDS["secret"]))


def features(x: Column) -> dict[str, Column]:
    s = x["s"]
    count = lambda c: F.length(s) - F.length(F.translate(s, c, ""))
    digits = digits_of(s)
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "chars": F.length(s), "digits": F.length(digits), "letters": F.length(F.regexp_replace(s, r"[^A-Za-z]", "")), "gaps": count(" -/"), "dots": count("."), "at": flag(s.rlike(_AT)), "plus": flag(F.startswith(s, F.lit("+"))),
        "brackets": count("()[]{}"), "luhn": flag(let(digits, luhn)), "octets": flag(octets_ok(F.regexp_replace(s, _DOT, "."))), "hex": flag(s.rlike("^[0-9a-fA-F]+$")), "word": flag(x["before"].rlike(WORDS)), "secret": flag(x["before"].rlike(SECRETS)), "assigned": flag(x["before"].rlike(ASSIGNED)), "open": flag(x["before"].rlike(r"(?:^|[^0-9A-Za-z])$")), "closed": flag(x["after"].rlike(r"^(?:[^0-9A-Za-z]|$)")),
        "like_email": flag(x["kind"] == "email"), "like_ip": flag(x["kind"] == "ip"), "like_card": flag(x["kind"] == "card"), "like_secret": flag(x["kind"] == "secret"),
    }


def label(x: Column) -> Column:
    """1.0, 0.0 or null for a candidate, from its own text and what stands before it."""
    kind, s, before = x["kind"], x["s"], x["before"]
    whole = {k: s.rlike("^(?:" + PATTERNS[k].replace(r"(?:\G|(?<!" + _NAME + "))", "") + ")$") for k in KINDS}
    number = kind.isin("card", "phone")
    fits, fails = F.lit(False), number & whole["ip"] & ~passes("ip", s)
    for k in KINDS:
        fits = fits | ((kind == k) & whole[k] & passes(k, s))
        fails = fails | ((kind == k) & whole[k] & _failing(k)(x))
    bare = number & s.rlike("^[0-9]+$")
    called = (kind == "phone") & ~bare & before.rlike(CALLS) & passes("phone", s)
    paid = (kind == "card") & before.rlike(CARDS) & ~_failing("card")(x)
    secret = (kind == "secret") & before.rlike(SECRETS)
    no = fails | (number & s.rlike(DATE)) | (bare & (kind == "phone") & ~before.rlike(WORDS)) | ((kind == "secret") & ~before.rlike(SECRETS))
    return F.when(fits, 1.0).when(no, 0.0).when(called | paid | (secret & before.rlike(ASSIGNED)), 1.0)


def seeds(spark: SparkSession, each: int = 20) -> DataFrame:
    """text, label: made texts with one kind of candidate each, the same at each call."""
    r = random.Random(20240601)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstuvw") for _ in range(r.randint(3, 8)))
    mixed = lambda n: name() + "".join(r.choice("abcdef0123456789") for _ in range(n - 2)) + digits(2)
    hexed = lambda n: "".join(r.choice("abcdef0123456789") for _ in range(n - 2)) + "a1"
    octet = lambda: str(r.randint(1, 255))

    def card(n: int, good: bool) -> str:
        body = digits(n - 1)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return body + str((-total % 10 + (0 if good else r.randint(1, 9))) % 10)

    spaced = lambda c: " ".join(c[k : k + 4] for k in range(0, len(c), 4))
    made = []
    for _ in range(each):
        yes = [
            f"mail {name()} [at] {name()} [dot] org", f"{name()} (at) {name()}.{name()}", f"write to {name()}@{name()}.net please", f"{name()} {name()}.{name()}[at]{name()}(dot)com {name()}",
            f"host {octet()}[.]{octet()}[.]{octet()}[.]{octet()}", f"{name()} {octet()}.{octet()}.{octet()}.{octet()} {name()}", f"{octet()}(dot){octet()}(dot){octet()}(dot){octet()}",
            f"call ({digits(3)}) {digits(3)}-{digits(4)}", f"tel 0{digits(2)} {digits(7)}", f"phone {digits(3)}-{digits(3)}-{digits(4)}", f"{name()} +{r.randint(1, 9)} ({digits(3)}) {digits(3)}-{digits(4)}",
            f"card {spaced(card(15, True))}", f"visa {card(16, True)}", f"{name()} {spaced(card(16, True))} {name()}",
            f'token = "{hexed(40)}"', f"api_key: {mixed(24)}", f"password={mixed(18)}", f"secret => '{mixed(32)}' {name()}",
        ]
        no = [
            f"{name()} [at] {name()}", f"on 20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)} {name()}", f"order {digits(8)}", f"{name()} {digits(10)} {name()}", f"{name()} {card(16, False)}", f"card {spaced(card(16, False))}",
            f"9{digits(2)}.3{digits(2)}.{octet()}.{octet()}", f"commit {hexed(40)}", f"{name()} {mixed(20)} {name()}", f"id {hexed(32)} {name()}", f"no {digits(7)}", f"{name()}_{mixed(16)}_{name()}", f"pages {digits(3)}-{digits(3)}, {digits(4)}",
        ]
        made += [(t, 1.0) for t in yes] + [(t, 0.0) for t in no]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(t).alias("text"), F.lit(y).alias("label")) for t, y in made])))


def labelled(docs: DataFrame, sample: int = SAMPLE, limit: int = CANDIDATES) -> DataFrame:
    """docs: doc_id, text. label, fold and the features of the sample's labelled candidates and of the seeds'."""
    x = F.col("x")
    some = least_hashes(docs, ["doc_id", "text"], sample).withColumn("x", F.explode(candidates(F.col("text"))))
    some = some.select("x", label(x).alias("label"), F.xxhash64("doc_id", "text", "x.start").alias("h")).filter("label is not null").orderBy("h", "x").limit(limit)
    made = seeds(docs.sparkSession).withColumn("x", F.explode(candidates(F.col("text")))).select("x", "label", F.xxhash64("text").alias("h"))
    both = some.unionByName(made)
    return both.select("label", F.pmod("h", F.lit(3)).alias("fold"), *[c.cast("double").alias(k) for k, c in features(x).items()]).orderBy("h", "x")


def train(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> tuple[boosting.Model, float]:
    """docs: doc_id, text. The trees and their threshold."""
    got = labelled(docs, sample).collect()
    y = np.array([r["label"] for r in got], float)
    m = np.array([[r[k] for k in FEATURES] for r in got], float).reshape(len(got), len(FEATURES))
    out = np.array([r["fold"] == 0 for r in got], bool)
    model = boosting.fit(m[~out], y[~out], list(FEATURES), rounds=16, depth=4)
    limit = boosting.threshold(model.score(m[out]), y[out], precision, prior=1)
    return model, limit if np.isfinite(limit) else float(np.log(precision / (1 - precision)))


def detect(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """doc_id, email, ip, card, phone (base spans) and more (spans the trees add), each an array of structs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return judged(rows, *train(rows, sample, precision))


def judged(rows: DataFrame, model: boosting.Model, limit: float) -> DataFrame:
    """detect() with trees and a threshold at hand. rows: doc_id, text."""
    text = F.col("text")
    rows = rows.withColumns(base_spans(text))

    def score(x: Column) -> Column:
        return let(F.struct(*[c.cast("double").alias(k) for k, c in features(x).items()]), lambda f: model.column(lambda n: f[n]))

    fresh = let(F.concat(*KINDS), lambda b: let(candidates(text), lambda c: apart(c, b)))
    more = F.filter(fresh, lambda x: score(x) >= limit)
    return rows.withColumn("more", F.when(text.rlike(r"[0-9]|@|(?i:[\[({]\x20?at)"), more).otherwise(F.array().cast(SPAN)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in angle brackets; of spans that overlap, the first."""
    d = detect(docs)
    places = F.array_sort(F.transform(F.concat(*KINDS, "more"), lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["kind"].alias("kind"))))
    reach = lambda p: running(F.transform(p, lambda x: -x["back"]), lambda a, b: F.greatest(a, b))
    before = lambda r, i: F.coalesce(F.get(r, i - 1), F.lit(0))  # noqa: E731  how far earlier spans reach
    # each span gives the text between and, unless an earlier one covers its start, its mark
    piece = lambda p, r: F.transform(p, lambda x, i: F.concat(F.substring(F.col("text"), before(r, i) + 1, F.greatest(x["start"] - before(r, i), F.lit(0))), F.when(x["start"] >= before(r, i), F.concat(F.lit("<"), x["kind"], F.lit(">"))).otherwise("")))
    done = let(places, lambda p: let(reach(p), lambda r: F.concat(F.array_join(piece(p, r), ""), F.substring(F.col("text"), F.coalesce(F.get(r, F.size(r) - 1), F.lit(0)) + 1, F.length("text")))))
    return d.select("doc_id", done.alias("text"))


def report(docs: DataFrame) -> DataFrame:
    """The digest for each document. Counts and hash are of base spans; n_spans counts all."""
    d = detect(docs)
    order = F.array_sort(F.transform(F.concat(*KINDS, "more"), lambda x: F.struct(F.array_position(F.array(*map(F.lit, (*KINDS, "secret"))), x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return d.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_joined(F.concat(*KINDS)), 256).alias("base_sha256"), _joined(order).alias("spans"),
        F.size("more").cast("long").alias("n_more"), F.size(order).cast("long").alias("n_spans"),
    )
