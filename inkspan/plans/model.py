"""Adapters: the concepts of the engine over the driver's tables, and the same as SQL.

documents give books (source), chapters (doc_id), paragraphs (lines) and sentences (by a terminator set). A short
constant dictionary gives two kinds of entities; their surfaces are found by one alternation, longest first, so that
matches are leftmost-longest and do not overlap.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.text import short_id

SENTENCE = r"([^.!?]*[.!?][\"')\]]*|[^.!?]+\z)"
CJK_SENTENCE = r"([^。！？]*[。！？][」』”’）\]]*|[^。！？]+\z)"

#: id, name, era rank, books (null: all), aliases.
PERSONS = [
    ("p01", "that", 1, None, ["that", "than"]),
    ("p02", "with", 2, None, ["with", "whou"]),
    ("p03", "ther", 3, ["src0", "src1", "src2"], ["ther", "thre"]),
    ("p04", "ich", None, None, ["ich", "lich"]),
    ("p05", "que", 5, None, ["que", "eau"]),
    ("p06", "und", 6, ["src3", "src4"], ["und", "ung"]),
]
PLACES = [("l01", "tion", "city", ["tion", "ation"]), ("l02", "ment", "river", ["ment"]), ("l03", "heit", "city", ["heit", "keit"]), ("l04", "ould", "hill", ["ould", "ould."]), ("l05", "rent", "river", ["rent", "rest"])]
#: Closed range of eras of a book; books not listed have none.
ERAS = [("src0", 1, 3), ("src1", 2, 5), ("src2", 4, 6), ("src3", 1, 1)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small input may be one row group, which one task reads; its rows are dealt out to all cores. A large one has
    row groups enough and is not moved."""
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * (32 << 20) else df


def paragraphs(docs: DataFrame) -> DataFrame:
    """chapter, book, lang, para_seq (from 1), text."""
    return docs.select(F.col("doc_id").alias("chapter"), F.col("source").alias("book"), "lang", F.posexplode(F.split("text", "\n", -1)).alias("p", "text")).select("chapter", "book", "lang", (F.col("p") + 1).alias("para_seq"), "text")


def split_sentences(paras: DataFrame, pattern: str = SENTENCE) -> DataFrame:
    """Terminator and closers stay with the sentence, a tail without terminator is kept, blank ones are dropped.
    Adds seq (place among all matches) and uid (from the position alone)."""
    s = paras.select("chapter", "book", "lang", "para_seq", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("q", "text"))
    s = s.filter(F.trim("text") != "").withColumn("seq", F.col("q") + 1)
    return s.select("chapter", "book", "lang", "para_seq", "seq", "text", short_id(F.col("chapter"), F.col("para_seq"), F.col("seq")).alias("uid"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(paragraphs(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))))


def persons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PERSONS, "id string, name string, era_rank int, books array<string>, aliases array<string>")


def places(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLACES, "id string, name string, kind string, aliases array<string>")


def book_eras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERAS, "book string, era_from int, era_to int")


def alternation(aliases: list[str]) -> str:
    """Longest first, then by code point."""
    import re

    return "|".join(re.escape(a) for a in sorted(set(aliases), key=lambda a: (-len(a), a)))


def surfaces(entities: list[tuple]) -> dict[str, str]:
    """Alias to id; where two own an alias, the greatest id."""
    out: dict[str, str] = {}
    for e in sorted(entities):
        for a in e[-1]:
            out[a] = max(e[0], out.get(a, ""))
    return out


def find_mentions(sents: DataFrame, owner: dict[str, str]) -> DataFrame:
    """A row for each match: uid, chapter, book, nth (in the sentence), surface, id. No join: the few owners
    are a constant map in the expression."""
    own = F.create_map(*[F.lit(v) for kv in sorted(owner.items()) for v in kv])
    m = sents.select("uid", "chapter", "book", "para_seq", "seq", F.posexplode(F.regexp_extract_all("text", F.lit(alternation(list(owner))), F.lit(0))).alias("k", "surface"))
    return m.select("uid", "chapter", "book", "para_seq", "seq", (F.col("k") + 1).alias("nth"), "surface", F.element_at(own, F.col("surface")).alias("id"))


def mentions(spark: SparkSession, sf_dir: str, entities: list[tuple] = PERSONS) -> DataFrame:
    return find_mentions(sentences(spark, sf_dir), surfaces(entities))


def q(text: str | None) -> str:
    return "NULL" if text is None else "'" + str(text).replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list; lists become SQL lists."""

    def one(v):
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(one, v)) + "]"
        return str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).lower() if isinstance(v, bool) else q(v)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) v({columns}))"


PARA_SQL = """para AS (SELECT doc_id AS chapter, source AS book, lang, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS para_seq FROM documents)"""
SENT_SQL = (
    PARA_SQL
    + f""",
sent0 AS (SELECT chapter, book, lang, para_seq, unnest(regexp_extract_all(text, {q(SENTENCE)}, 1)) AS text, generate_subscripts(regexp_extract_all(text, {q(SENTENCE)}, 1), 1) AS seq FROM para),
sent AS (SELECT *, substr(md5(chapter || '|' || para_seq || '|' || seq), 1, 12) AS uid FROM sent0 WHERE trim(text) <> '')"""
)


def mention_sql(name: str, entities: list[tuple]) -> str:
    """A CTE of mentions after SENT_SQL."""
    owner = surfaces(entities)
    pattern = q(alternation(list(owner)))
    return f"""{name}0 AS (SELECT uid, chapter, book, para_seq, seq, unnest(regexp_extract_all(text, {pattern})) AS surface, generate_subscripts(regexp_extract_all(text, {pattern}), 1) AS nth FROM sent),
{name} AS (SELECT m.*, o.id FROM {name}0 m JOIN {values(sorted(owner.items()), 'alias, id')} o ON o.alias = m.surface)"""


M = "WITH " + SENT_SQL + ",\n" + mention_sql("ment", PERSONS)
MP = M + ",\n" + mention_sql("pment", PLACES)
PERSON_SQL = values([(p[0], p[1], -1 if p[2] is None else p[2]) for p in PERSONS], "id, name, era_rank")
PLACE_SQL = values([p[:3] for p in PLACES], "id, name, kind")


def any_of(*conditions):
    return reduce(lambda a, b: a | b, conditions)
