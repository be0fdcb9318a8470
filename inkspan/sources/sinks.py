"""Sinks. A table that is replaced is written beside the old one and takes its name when it is whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def swapped(df: DataFrame, path: str, write) -> None:
    """write(DataFrameWriter, path) to a folder beside path, which is renamed to path once the job has committed. Until
    then readers see the old table; between the two renames there is none, and the old one is deleted last."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, old, now = (hadoop(path.rstrip("/") + end) for end in (".new", ".old", ""))
    store = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(old) and not store.exists(now):  # an earlier run ended between its renames
        store.rename(old, now)
    write(df.write.mode("overwrite"), new.toString())
    if store.exists(now):
        store.delete(old, True)
        store.rename(now, old)
    store.rename(new, now)
    store.delete(old, True)


def json_by_book(sents: DataFrame, path: str) -> None:
    """K1, K2: a folder for each book, a line of JSON for each chapter."""
    nested = sents.groupBy("book", "chapter").agg(F.sort_array(F.collect_list(F.struct("para_seq", "seq", "uid", "text"))).alias("sentences"))
    swapped(nested, path, lambda w, at: w.partitionBy("book").json(at))


def last_wins(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """K3: one row for each key, the last written."""
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def char_tokens(text: Column) -> Column:
    """K4: a token for each character."""
    return F.split(text, "")


def js_safe(json: Column) -> Column:
    """K6: JSON that may stand in a single-quoted string of a script."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("</", "<\\/"), (" ", "\\u2028"), (" ", "\\u2029")):
        json = F.replace(json, F.lit(a), F.lit(b))
    return json


def encoded(mentions: DataFrame, sents: DataFrame) -> DataFrame:
    """K5: mentions with a sentence's ordinal in place of its uid. Chapter starts are summed over chapters, ordinals
    within a chapter by a window on the chapter, so no window holds all sentences."""
    from inkspan.operators.index import chapter_ranges

    w = Window.partitionBy("chapter").orderBy("para_seq", "seq")
    at = sents.withColumn("k", F.row_number().over(w) - 1).join(chapter_ranges(sents).select("chapter", "start"), "chapter").select("uid", (F.col("start") + F.col("k")).alias("ordinal"))
    return mentions.join(at, "uid").groupBy("id").agg(F.to_json(F.sort_array(F.collect_list(F.array("ordinal", F.col("nth").cast("long"))))).alias("block"))


def with_human_columns(fresh: DataFrame, before: DataFrame, key: str, human: list[str]) -> DataFrame:
    """K7, K9: an exported sheet in which people's own columns outlive the export."""
    return fresh.join(before.select(key, *human), key, "left")


def same_year_many_places(rows: DataFrame) -> DataFrame:
    """Flags (person, year) with several places."""
    g = rows.filter("year is not null").groupBy("person", "year").agg((F.count_distinct("place") > 1).alias("many"))
    return rows.join(g, ["person", "year"], "left").fillna(False, ["many"])


def stale(live: DataFrame, exported: DataFrame, at_most: tuple[str, ...] = ()) -> DataFrame:
    """Counts (key, n) that differ; for keys in at_most the export may have fewer."""
    both = live.join(exported.withColumnRenamed("n", "exported"), "key", "full_outer").fillna(0, ["n", "exported"])
    loose = F.col("key").isin(*at_most) if at_most else F.lit(False)
    return both.filter(F.when(loose, F.col("exported") > F.col("n")).otherwise(F.col("exported") != F.col("n")))


def markdown(rows: DataFrame, title: Column, line: Column, order: list[str]) -> DataFrame:
    """A section for each title, its lines in order."""
    g = rows.select(title.alias("title"), F.struct(*order, line.alias("line")).alias("x")).groupBy("title").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return g.select("title", F.concat(F.lit("## "), "title", F.lit("\n\n"), F.array_join(F.transform("xs", lambda x: F.concat(F.lit("- "), x["line"])), "\n")).alias("value"))
