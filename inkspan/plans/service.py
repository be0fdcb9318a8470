"""The query surface: a function for each endpoint, giving DataFrames or dicts of them. Nothing runs until one is read."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.functions.text import books_of
from inkspan.operators import graph, index, versions

MOST_LETTERS, MOST_ROWS, MOST_SENTENCES = 64, 500, 5000


def checked(text: str) -> str:
    """P14."""
    text = (text or "").strip()
    if not text or len(text) > MOST_LETTERS:
        raise ValueError("a query has 1 to 64 characters")
    return text


def clamped(limit: int, most: int = MOST_ROWS) -> int:
    return max(1, min(int(limit), most))


@dataclass
class Index:
    """Tables: sents (uid, chapter, book, para_seq, seq, text), mentions and place_mentions (uid, chapter, book, nth,
    surface, id), persons and places (id, name, aliases), eras (book, era_from, era_to), relations (a, b, rel),
    trajectories (person, place, year, ord)."""

    sents: DataFrame
    mentions: DataFrame
    place_mentions: DataFrame
    persons: DataFrame
    places: DataFrame
    eras: DataFrame
    relations: DataFrame
    trajectories: DataFrame
    books: tuple[str, ...]

    def health(self) -> dict:
        return {"ok": True, "books": list(self.books)}

    def stats(self) -> dict[str, DataFrame]:
        one = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
        return {k: one(getattr(self, k)) for k in ("sents", "mentions", "place_mentions", "persons", "places")}

    def index(self, book: str | None = None) -> dict[str, DataFrame]:
        chosen = books_of(book, list(self.books))
        count = lambda m: index.narrowed(index.counts_by_book(m), chosen)
        return {"persons": index.entity_index(count(self.mentions), self.persons.select("id", "name")), "places": index.entity_index(count(self.place_mentions), self.places.select("id", "name")), "chapters": index.chapter_ranges(self.sents), "quick": self.quick()}

    def quick(self, limit: int = 8) -> DataFrame:
        return self.mentions.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chapter").alias("c")).orderBy(F.desc("c"), F.desc("n"), "surface").limit(clamped(limit))

    def search(self, text: str, limit: int = 20) -> dict[str, DataFrame]:
        text = checked(text)
        return {k: index.search(d, text).orderBy("id").limit(clamped(limit)) for k, d in (("persons", self.persons), ("places", self.places))}

    def fts(self, text: str, limit: int = 50) -> DataFrame:
        return index.phrase(self.sents, checked(text)).orderBy("chapter", "para_seq", "seq").limit(clamped(limit))

    def person(self, pid: str, book: str | None = None, era: int | None = None, limit: int = 200) -> dict[str, DataFrame]:
        """Mentions are cut to the limit; counts by book are of all."""
        chosen = books_of(book, list(self.books))
        mine = self.mentions.filter(F.col("id") == pid)
        found = mine if chosen is None else mine.filter(F.col("book").isin(*chosen))
        found = found if era is None else index.in_era(found, self.eras, era)
        both = index.cooccurrence(mine, self.place_mentions)
        return {
            "person": self.persons.filter(F.col("id") == pid),
            "mentions": found.join(self.sents.select("uid", "text"), "uid", "left").orderBy("chapter", "para_seq", "seq", "nth").limit(clamped(limit)),
            "by_book": index.zero_filled(index.counts_by_book(mine), self.eras.sparkSession.createDataFrame([(b,) for b in self.books], "book string"), self.persons.filter(F.col("id") == pid)),
            "places": both.orderBy(F.desc("n"), "b").limit(8),
            "relations": self.relations_of(pid, 1),
        }

    def place(self, pid: str, limit: int = 200) -> dict[str, DataFrame]:
        mine = self.place_mentions.filter(F.col("id") == pid)
        return {"place": self.places.filter(F.col("id") == pid), "mentions": mine.orderBy("chapter", "para_seq", "seq", "nth").limit(clamped(limit)), "persons": index.cooccurrence(self.mentions, mine).orderBy(F.desc("n"), "a").limit(8)}

    def chapter(self, chapter) -> DataFrame:
        return self.sents.filter(F.col("chapter") == chapter).orderBy("para_seq", "seq").limit(MOST_SENTENCES)

    def sentence(self, uid: str) -> dict[str, DataFrame]:
        if not re.fullmatch(r"[0-9a-f]{12}", uid):
            raise ValueError("a sentence id is 12 hex digits")
        return {"sentence": self.sents.filter(F.col("uid") == uid), "mentions": self.mentions.filter(F.col("uid") == uid), "places": self.place_mentions.filter(F.col("uid") == uid)}

    def relations_of(self, pid: str, degree: int = 1, rel: str | None = None, limit: int = 200) -> DataFrame:
        """Edges between nodes of the neighbourhood, with the degree at which each was reached."""
        edges = self.relations if rel is None else self.relations.filter(F.col("rel") == rel)
        start = self.persons.filter(F.col("id") == pid).select(F.col("id").alias("node"))
        seen = graph.neighbourhood(edges, start, max(1, min(degree, 3)))
        near = edges.join(seen.select(F.col("node").alias("a"), F.col("degree").alias("da")), "a").join(seen.select(F.col("node").alias("b"), F.col("degree").alias("db")), "b")
        return near.withColumn("degree", F.greatest("da", "db")).drop("da", "db").orderBy("degree", "a", "b", "rel").limit(clamped(limit))

    def trajectory(self, pid: str) -> DataFrame:
        return graph.stations(self.trajectories.filter(F.col("person") == pid), "person", "place", "year", "ord").orderBy(F.col("year").asc_nulls_last(), "ord")

    def trajectory_persons(self) -> DataFrame:
        return self.trajectories.groupBy("person").agg(F.count(F.lit(1)).alias("n"), F.count("year").alias("n_dated"))


def with_row(sheet: DataFrame, row: dict, key: list[str]) -> DataFrame:
    """An override or edit added to its sheet; active rows with the same key are revoked by it."""
    same = [F.col(k).eqNullSafe(F.lit(row.get(k))) for k in key]
    hit = same[0]
    for c in same[1:]:
        hit = hit & c
    old = sheet.withColumn("status", F.when(hit & (F.col("status") == "active"), "revoked").otherwise(F.col("status")))
    return old.unionByName(sheet.sparkSession.createDataFrame([{**{c: None for c in sheet.columns}, **row, "status": "active"}], sheet.schema))


def revoked(sheet: DataFrame, key: dict) -> DataFrame:
    hit = F.lit(True)
    for k, v in key.items():
        hit = hit & F.col(k).eqNullSafe(F.lit(v))
    return sheet.withColumn("status", F.when(hit, "revoked").otherwise(F.col("status")))


def rebuilt(sents: DataFrame, edits: DataFrame, mentions: DataFrame, overrides: DataFrame, before: DataFrame) -> dict[str, DataFrame]:
    """The rebuild: edits replayed, overrides applied, and what changed since the last snapshot."""
    now = versions.overridden(mentions, overrides)
    return {"sents": versions.replayed(sents, edits), "mentions": now, "diff": versions.diff(before, now)}


