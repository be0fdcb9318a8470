"""Annotation: spans of dictionary entities, and the attribution of titles that many bear.

Plain spans are found in the JVM: matches by one alternation (longest first, so leftmost-longest), offsets as sums of
the lengths of gaps and matches, in code points. The state of attribution lives within a chapter, so chapters are
resolved by a grouped map on the chapter, whose rows are its sentences.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.plans.model import alternation

SPAN = "array<struct<s:int,e:int,id:string,surface:string,tier:string>>"
#: Words a title's paragraph and chapter signals must reach.
PARAGRAPH_NEED, CHAPTER_NEED, ROUNDS = 1, 2, 3


def spans_in(text: Column, owner: dict[str, str], tier: str = "core", folded: Column | None = None) -> Column:
    """Spans of the dictionary's aliases. folded: a form of the text of equal length in which they are looked for;
    surfaces are always cut from the text itself."""
    look = text if folded is None else folded
    pattern = alternation(list(owner))
    own = F.create_map(*[F.lit(v) for kv in sorted(owner.items()) for v in kv])
    hits, gaps = F.regexp_extract_all(look, F.lit(pattern), F.lit(0)), F.split(look, pattern, -1)

    def place(pair: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            s = acc["at"] + F.length(pair["g"][i])
            n = F.length(pair["h"][i])
            one = F.struct(s.alias("s"), (s + n).alias("e"), F.element_at(own, pair["h"][i]).alias("id"), F.substring(text, s + 1, n).alias("surface"), F.lit(tier).alias("tier"))
            return F.struct((s + n).alias("at"), F.concat(acc["out"], F.array(one).cast(SPAN)).alias("out"))

        return F.when(F.size(pair["h"]) == 0, F.array().cast(SPAN)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(pair["h"]) - 1), F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")), step, lambda a: a["out"]))

    return F.transform(F.array(F.struct(hits.alias("h"), gaps.alias("g"))), place)[0]


def overlaps(x: Column, y: Column) -> Column:
    """P12."""
    return (x["s"] < y["e"]) & (y["s"] < x["e"])


def guarded(spans: Column, text: Column, before: dict[str, str] | None = None, after: dict[str, str] | None = None) -> Column:
    """Drops spans whose neighbour is one of the characters listed for their surface."""

    def ok(x: Column) -> Column:
        good = F.lit(True)
        for table, at in ((before, x["s"]), (after, x["e"] + 1)):
            for surface, chars in (table or {}).items():
                good = good & ~((x["surface"] == surface) & F.when(at > 0, F.substring(text, at, F.lit(1)).isin(*chars)).otherwise(F.lit(False)))
        return good

    return F.filter(spans, ok)


def added(spans: Column, more: Column, whole: bool = False) -> Column:
    """Further spans where no earlier one starts (whole: overlaps)."""
    free = F.filter(more, lambda x: ~F.exists(spans, lambda y: overlaps(x, y) if whole else y["s"] == x["s"]))
    return F.array_sort(F.concat(spans, free))


def places_of(text: Column, name: str) -> Column:
    """Where the name starts, overlapping places too."""

    def here(i: Column) -> Column:
        return F.substring(text, i + 1, F.lit(len(name))) == name

    return F.when(F.contains(text, F.lit(name)), F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - len(name), F.lit(0))), here)).otherwise(F.array().cast("array<int>"))


def _outside(starts: Column, n: int):
    """A test: the span is no part of a longer name of n characters at these places."""

    def test(x: Column) -> Column:
        return ~F.exists(starts, lambda i: (i < x["e"]) & (x["s"] < i + n) & ((x["e"] - x["s"]) < n))

    return test


def place_spans(text: Column, owner: dict[str, str], person_spans: Column, off: tuple[str, ...] = (), blocked: tuple[str, ...] = (), longer: tuple[str, ...] = (), peerage: str = "王公侯", posthumous: str = "文武成康昭穆") -> Column:
    """Places, without those that are switched off, that a longer known name cuts short, that stand in a
    blocked name, or that overlap a person, unless that person is a place, a posthumous character and a rank."""
    spans = F.filter(spans_in(text, owner), lambda x: ~x["surface"].isin(*off) if off else F.lit(True))
    for name in longer + blocked:
        spans = F.filter(spans, _outside(places_of(text, name), len(name)))
    exempt = lambda x, y: (y["s"] == x["s"]) & (F.length(y["surface"]) == 3) & F.substring(y["surface"], 2, 1).isin(*posthumous) & F.substring(y["surface"], 3, 1).isin(*peerage)
    return F.filter(spans, lambda x: ~F.exists(person_spans, lambda y: overlaps(x, y) & ~exempt(x, y)))


@dataclass(frozen=True)
class Title:
    """An alias that several persons bear. rules: (scope, key, person or None)."""

    alias: str
    candidates: tuple[str, ...]
    default: str | None = None
    by_book: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rules: tuple[tuple[str, str, str | None], ...] = ()


@dataclass
class Evidence:
    """What is known where a title stands."""

    owners: set[str] = field(default_factory=set)
    related: set[str] = field(default_factory=set)
    sentence: Counter = field(default_factory=Counter)
    paragraph: Counter = field(default_factory=Counter)
    chapter: Counter = field(default_factory=Counter)
    era: str | None = None  # the chapter's
    book: str | None = None
    text: str = ""
    span: tuple[int, int] = (0, 0)


def ahead(counts: Counter, candidates: list[str], need: int) -> str | None:
    """The candidate with the most, if it has `need` and stands alone."""
    top = sorted(((counts.get(c, 0), c) for c in candidates), reverse=True)[:2]
    return top[0][1] if top and top[0][0] >= need and (len(top) == 1 or top[1][0] < top[0][0]) else None


def by_rule(title: Title, ev: Evidence) -> tuple[bool, str | None]:
    """P10: the first rule whose key stands in its scope."""
    s, e = ev.span
    scopes = {"post": ev.text[e : e + 6], "pre": ev.text[max(0, s - 6) : s], "sent": ev.text, "sentence": ev.text}
    window = ev.text[max(0, s - 24) : s] + ev.text[e : e + 24]
    return next(((True, who) for scope, key, who in title.rules if key in scopes.get(scope, window)), (False, None))


@dataclass(frozen=True)
class Case:
    """A title at a place, as the rungs see it: who can be meant in its book, and whether the book has narrowed that down."""

    title: Title
    ev: Evidence
    eras: tuple[str, ...]
    era_of: dict[str, str]
    books_of: dict[str, set[str]]

    def allowed(self, who: str | None) -> bool:
        return not self.books_of.get(who) or self.ev.book in self.books_of[who]

    @cached_property
    def shelf(self) -> list[str] | None:
        """The candidates that a dictionary names for the book; None where it says nothing."""
        if not (self.title.by_book and self.ev.book):
            return None
        named = self.title.by_book.get(self.ev.book, ())
        return [c for c in named if c in self.title.candidates] or list(named)

    @cached_property
    def pool(self) -> list[str]:
        wide = list(self.title.candidates) if self.shelf is None else self.shelf
        return wide if len(wide) == 1 and self.shelf else [c for c in wide if self.allowed(c)] if self.scoped else wide

    @property
    def scoped(self) -> bool:
        return self.ev.book is not None and bool(self.books_of)

    def years(self, who: str | None, back: int = 0) -> int | None:
        """How many eras after the chapter's a person lived; negative: before it."""
        if self.era_of.get(who) not in self.eras or self.ev.era not in self.eras:
            return None
        return self.eras.index(self.era_of[who]) - self.eras.index(self.ev.era) + back


# A rung returns (person or None, tier) where it decides and None where it does not.


def _stated(c: Case):
    """Words next to the title that settle it, also that nobody is meant."""
    ruled, who = by_rule(c.title, c.ev)
    if ruled and who is None:
        return None, "none"
    return (who, "sentence") if ruled and who in c.title.candidates and (c.ev.book is None or c.allowed(who)) else None


def _left_by_book(c: Case):
    """The book leaves one candidate, or none."""
    if c.shelf == [] or (c.scoped and not c.pool):
        return None, "none"
    return (c.pool[0], "era") if len(c.pool) == 1 and (c.shelf or c.scoped) else None


def _one_of(known: str, tier: str):
    """One candidate alone is among the chapter's own or related persons."""

    def rung(c: Case):
        here = [x for x in c.pool if x in getattr(c.ev, known)]
        return (here[0], tier) if len(here) == 1 else None

    return rung


def _most_named(place: str, need: int):
    """One candidate is named more often than the others nearby."""

    def rung(c: Case):
        who = ahead(getattr(c.ev, place), c.pool, need)
        return (who, place) if who is not None else None

    return rung


def _of_the_era(c: Case):
    """One candidate alone lived in the chapter's era."""
    same = [x for x in c.pool if c.ev.era is not None and c.era_of.get(x) == c.ev.era]
    return (same[0], "era") if len(same) == 1 else None


def _by_default(c: Case):
    """The dictionary's default, as far as eras allow: nobody from two eras later or more; a guess where it fits; for somebody
    from before the chapter's era, whoever lived within three eras of it comes first."""
    who = c.title.default
    gap = c.years(who)
    if not who or not c.allowed(who) or (gap is not None and gap >= 2):
        return None, "none"
    if gap is None or gap >= 0:
        return who, "guess"
    near = [x for x in c.pool if (y := c.years(x, 3)) is not None and y >= 0]
    return {0: (who, "era"), 1: (near[0] if near else who, "era")}.get(len(near), (who, "guess"))


#: From hard evidence to soft; the first rung that decides wins, and the last one always does.
LADDER = (
    _stated, _left_by_book, _one_of("owners", "owner"), _one_of("related", "related"), _most_named("sentence", 1), _most_named("paragraph", PARAGRAPH_NEED), _most_named("chapter", CHAPTER_NEED), _of_the_era, _by_default,
)


def attribute(title: Title, ev: Evidence, eras: tuple[str, ...], era_of: dict[str, str], books_of: dict[str, set[str]]) -> tuple[str | None, str]:
    """(person or None, tier)."""
    case = Case(title, ev, eras, era_of, books_of)
    return next(found for rung in LADDER if (found := rung(case)) is not None)


def resolve_chapter(sure: list[tuple[int, int, str]], open_: list[tuple[int, int, Title, Evidence]], eras=(), era_of=None, books_of=None) -> list[tuple[str | None, str]]:
    """Sure: (paragraph, sentence, person) of plain spans; open_: (paragraph, sentence, title, what is fixed).
    Attributions of one round are evidence in the next, but never for their own title; until nothing changes, or
    ROUNDS."""
    found: list[tuple[str | None, str]] = [(None, "none")] * len(open_)
    first = True
    for _ in range(ROUNDS):
        now = []
        # votes are counted once by place, with those of each title apart, so that it can be taken out again
        votes: Counter = Counter()
        for p, s, who in sure:
            votes.update([(who, None), (who, None, p), (who, None, p, s)])
        for (p, s, t, _), (who, _) in zip(open_, found):
            if who and not first:
                votes.update([(who, None), (who, None, p), (who, None, p, s), (who, t.alias), (who, t.alias, p), (who, t.alias, p, s)])
        for para, sent, title, fixed in open_:
            ev = Evidence(fixed.owners, fixed.related, era=fixed.era, book=fixed.book, text=fixed.text, span=fixed.span)
            everyone = {*title.candidates, *(title.by_book.get(fixed.book) or ())}
            for bag, place in ((ev.chapter, ()), (ev.paragraph, (para,)), (ev.sentence, (para, sent))):
                bag.update({c: n for c in everyone if (n := votes[(c, None, *place)] - votes[(c, title.alias, *place)]) > 0})
            now.append(attribute(title, ev, tuple(eras), era_of or {}, books_of or {}))
        if now == found:
            break
        found, first = now, False
    return found


def resolve_titles(
    sents: DataFrame, owner: dict[str, str], titles: list[Title], eras: tuple[str, ...] = (), era_of: dict[str, str] | None = None, books_of: dict[str, set[str]] | None = None, chapters: DataFrame | None = None
) -> DataFrame:
    """D4 to D6 over all chapters: uid, s, e, surface, id, tier of the titles' spans. chapters: chapter, owners, related (arrays of
    persons), era; a row for each chapter of which something is known."""
    by_alias = {t.alias: t for t in titles}
    plain = spans_in(F.col("text"), owner)
    open_ = F.filter(spans_in(F.col("text"), {t.alias: t.alias for t in titles}, "open"), lambda x: ~F.exists(F.col("plain"), lambda y: y["s"] == x["s"]))
    rows = sents.withColumn("plain", plain).withColumn("open", open_).select("chapter", "book", "para_seq", "seq", "uid", F.when(F.size("open") > 0, F.col("text")).alias("text"), F.transform("plain", lambda x: x["id"]).alias("plain"), "open")
    # a chapter without titles needs no grouped work; asked of the text, as a filter on spans would find them again
    busy = sents.filter(F.col("text").rlike(alternation(list(by_alias)))).select("chapter").distinct()
    if chapters is not None:  # what is known of a chapter goes with the chapters that have titles
        busy = busy.join(chapters.select("chapter", "owners", "related", "era"), "chapter", "left")
    else:
        busy = busy.withColumns({"owners": F.lit(None).cast("array<string>"), "related": F.lit(None).cast("array<string>"), "era": F.lit(None).cast("string")})

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["para_seq", "seq"])
        sure, spots, at = [], [], []
        known = lambda x: set() if x is None else set(x)
        for r in pdf.itertuples():
            sure += [(r.para_seq, r.seq, who) for who in r.plain]
            for x in r.open:
                spots.append((r.para_seq, r.seq, by_alias[x["surface"]], Evidence(known(r.owners), known(r.related), era=r.era, book=r.book, text=r.text, span=(x["s"], x["e"]))))
                at.append((r.uid, x["s"], x["e"], x["surface"]))
        got = resolve_chapter(sure, spots, eras, era_of, books_of)
        return pd.DataFrame([(*a, who, tier) for a, (who, tier) in zip(at, got)], columns=["uid", "s", "e", "surface", "id", "tier"])

    return rows.join(busy, "chapter").groupBy("chapter").applyInPandas(one, "uid string, s int, e int, surface string, id string, tier string")
