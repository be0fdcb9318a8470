"""Counts, indexes, co-occurrence and search over mentions. Every operator takes and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_by_book(mentions: DataFrame) -> DataFrame:
    """A2: id, book, n (mentions), c (chapters), in one pass. A chapter belongs to one book, so chapters are counted on
    (id, book, chapter) partial sums instead of a distinct aggregate that expands the rows."""
    per = mentions.groupBy("id", "book", "chapter").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("id", "book").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("c"))


def narrowed(counts: DataFrame, books: list[str] | None) -> DataFrame:
    """A3."""
    return counts if books is None else counts.filter(F.col("book").isin(*books))


def rolled_up(counts: DataFrame) -> DataFrame:
    """A4: sums over books."""
    return counts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def entity_index(counts: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities with mentions, totals and books by falling count."""
    per = counts.groupBy("id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("rank"), "book"))).alias("by_book"))
    per = per.withColumn("books", F.concat_ws(",", F.transform("by_book", lambda x: x["book"]))).drop("by_book")
    return entities.join(per, "id").filter("n > 0")


def zero_filled(counts: DataFrame, books: DataFrame, ids: DataFrame) -> DataFrame:
    """Every book for every id; both lists are short dimension tables."""
    every = ids.select("id", F.lit(1).alias("k")).join(books.select("book", F.lit(1).alias("k")), "k").drop("k")
    return every.join(counts.select("id", "book", "n"), ["id", "book"], "left").fillna(0, ["n"])


def top_per_group(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark cuts to k per group in each task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def cooccurrence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sentences that have both, by pair. Distinct (sentence, id) first, so no product of repeats arises."""
    a = left.select("uid", F.col("id").alias("a")).distinct()
    b = right.select("uid", F.col("id").alias("b")).distinct()
    return a.join(b, "uid").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def pair_sentences(mentions: DataFrame, a: str, b: str) -> DataFrame:
    """Sentences with both, and how many others each has."""
    s = mentions.groupBy("uid").agg(F.max((F.col("id") == a).cast("int")).alias("has_a"), F.max((F.col("id") == b).cast("int")).alias("has_b"), F.count_distinct(F.when(~F.col("id").isin(a, b), F.col("id"))).alias("others"))
    return s.filter("has_a = 1 and has_b = 1").select("uid", "others")


def in_era(mentions: DataFrame, eras: DataFrame, era: int) -> DataFrame:
    """Mentions in books whose range holds the era; a book without a range is left out."""
    return mentions.join(eras.filter((F.col("era_from") <= era) & (F.col("era_to") >= era)), "book", "left_semi")


def search(entities: DataFrame, text: str) -> DataFrame:
    """Name or any alias holds the text, ASCII case aside."""
    like = f"%{text}%"
    return entities.filter(F.col("name").ilike(like) | F.exists("aliases", lambda a: a.ilike(like)))


def resolve_name(entities: DataFrame, name: str) -> DataFrame:
    """Ids whose name is the text, or, if there are none, those with it as an alias."""
    hit = entities.withColumn("level", F.when(F.col("name") == name, 0).when(F.array_contains("aliases", name), 1)).filter("level is not null")
    return hit.withColumn("best", F.min("level").over(Window.partitionBy(F.lit(0)))).filter("level = best").select("id")  # a dimension's few hits


def phrase(sents: DataFrame, text: str) -> DataFrame:
    """Phrase search as by one token for each character: case and ASCII punctuation do not count."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", ""))
    return sents.filter(F.contains(bare(F.col("text")), bare(F.lit(text))))


def nth_mentions(mentions: DataFrame) -> DataFrame:
    """Place of each mention among those of the same surface in its sentence."""
    return mentions.withColumn("of_surface", F.row_number().over(Window.partitionBy("uid", "surface").orderBy("nth")))


def bucket_pivot(mentions: DataFrame, bounds: list[tuple[str, int, int]]) -> DataFrame:
    """A10: mentions in ranges of chapters, null where there are none."""
    return mentions.groupBy("id").agg(*[F.nullif(F.count_if(F.col("chapter").between(a, b)), F.lit(0)).alias(n) for n, a, b in bounds], F.count(F.lit(1)).alias("n_all"))


def grouped_aliases(mentions: DataFrame, key) -> DataFrame:
    """Surfaces of an entity that fold to one key: the most frequent form stands for them (ties: the least), with
    the sorted variants."""
    forms = mentions.groupBy("id", key.alias("key"), "surface").agg(F.count(F.lit(1)).alias("n"))
    g = forms.groupBy("id", "key").agg(F.min_by("surface", F.struct((-F.col("n")).alias("r"), "surface")).alias("w"), F.sum("n").alias("n"), F.concat_ws(",", F.sort_array(F.collect_set("surface"))).alias("variants"))
    return g.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "w")))


def declared_and_observed(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Declared aliases and surfaces seen, each with its count, declared ones first."""
    declared = entities.select("id", F.posexplode("aliases").alias("at", "w"))
    seen = mentions.groupBy("id", F.col("surface").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    both = declared.join(seen, ["id", "w"], "full_outer").fillna(0, ["n"])
    return both.withColumn("seq", F.row_number().over(Window.partitionBy("id").orderBy(F.col("at").asc_nulls_last(), F.desc("n"), "w"))).select("id", "w", "n", "seq")


def dominant(counts: DataFrame, by: list[str], need: int) -> DataFrame:
    """The group's id with the most, if it has `need` and no other has as many."""
    g = counts.groupBy(*by).agg(F.max("n").alias("most"), F.max_by("id", F.struct("n", "id")).alias("id"), F.collect_list("n").alias("all_n"))
    return g.filter((F.col("most") >= need) & (F.size(F.filter("all_n", lambda x: x == F.col("most"))) == 1)).select(*by, "id", F.col("most").alias("n"))


def chapter_ranges(sents: DataFrame) -> DataFrame:
    """Each chapter's [start, end) in the order of all sentences: sums of chapter sizes, so only a row for each
    chapter is ordered, not each sentence."""
    size = sents.groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.orderBy("chapter").rowsBetween(Window.unboundedPreceding, 0))
    return size.withColumn("end", end).select("chapter", (F.col("end") - F.col("n")).alias("start"), "end")


def quote_depth(sents: DataFrame, opener: str, closer: str) -> DataFrame:
    """open quotes after each sentence of a paragraph, never below zero: the running sum less its running minimum."""
    n = lambda c: F.length("text") - F.length(F.translate("text", c, ""))
    w = Window.partitionBy("chapter", "para_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = sents.withColumn("run", F.sum(n(opener) - n(closer)).over(w))
    return s.withColumn("depth", F.col("run") - F.least(F.lit(0), F.min("run").over(w))).drop("run")


def greedy_intervals(spans):
    """A Column: of spans (struct s, e), by start and falling length, those that do not overlap one before."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus_e"))))
    kept = F.aggregate(ordered, F.array().cast("array<struct<s:int,e:int>>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["s"] >= F.element_at(acc, -1)["e"]), F.concat(acc, F.array(F.struct(x["s"].cast("int").alias("s"), (-x["minus_e"]).cast("int").alias("e"))))).otherwise(acc))
    return kept
