"""Sources. Paths go to Spark's readers only, so any store that Spark reads will do."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.functions.text import volume_key

WAITS = (15, 30, 60, 90, 120)


def fetch(get: Callable[[dict], tuple[int, str]], params: dict, waits: tuple[int, ...] = WAITS, sleep: Callable[[float], None] = time.sleep) -> dict:
    """get(params) -> (status, body), again after a wait for 429 and 5xx. The transport is the caller's."""
    for wait in (*waits, None):
        status, body = get(params)
        if status == 200:
            return json.loads(body)
        if wait is None or not (status == 429 or status >= 500):
            raise OSError(f"status {status} for {params}")
        sleep(wait)
    raise AssertionError


def listing(get: Callable[[dict], tuple[int, str]], prefix: str) -> list[str]:
    """All titles under a prefix, page by page."""
    out, more = [], {}
    while True:
        got = fetch(get, {"action": "query", "list": "allpages", "apprefix": prefix, **more})
        out += [p["title"] for p in got["query"]["allpages"]]
        more = got.get("continue")
        if not more:
            return out


def canonical(titles: DataFrame, redirects: DataFrame) -> DataFrame:
    """S3: titles (title), redirects (title, target): each target once."""
    return titles.join(redirects, "title", "left").select(F.coalesce("target", "title").alias("title")).distinct()


def to_fetch(wanted: DataFrame, landed: DataFrame, least: int = 500) -> DataFrame:
    """What has not landed, or only as a stub (landed: name, size)."""
    return wanted.join(landed.filter(F.col("size") > least).select("name"), "name", "left_anti")


def title_tag(html):
    """A Column: the title as it stands, without the space characters around it (Unicode's Zs, as SQL's trim; no line ends
    or tabs). No title: empty."""
    return F.regexp_replace(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1), r"\A\p{Zs}+|\p{Zs}+\z", "")


def page_title(html):
    """A Column: the title without its leading number."""
    return F.trim(F.regexp_replace(title_tag(html), r"^\s*(?:\d+|[一二三四五六七八九十百]+)[\s.、]+", ""))


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files with slug and sort key."""
    r = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return r.select(F.regexp_extract("file", r"([^-/]+)-([^/]*)\.html?$", 1).alias("code"), F.regexp_extract("file", r"([^-/]+)-([^/]*)\.html?$", 2).alias("slug"), F.col("value").alias("html")).withColumn("key", volume_key(F.col("slug")))


CORPUS = "bookId string, chapterId string, slug string, title string, paragraphs array<struct<seq:int,text:string,note:string,sentences:array<struct<id:string,seq:double,uid:string,text:string,status:string>>>>"


def corpus(spark: SparkSession, path: str, books: DataFrame) -> DataFrame:
    """Sentences of corpus JSON, of ready books only; books: code, ord, ready."""
    docs = spark.read.schema(CORPUS).json(path, multiLine=True).join(books.filter("ready").select(F.col("code").alias("bookId"), "ord"), "bookId")
    p = docs.select("bookId", "ord", "chapterId", F.explode("paragraphs").alias("p"))
    s = p.select("bookId", "ord", "chapterId", F.col("p.seq").alias("para_seq"), F.explode("p.sentences").alias("s"))
    return s.select("bookId", "ord", "chapterId", "para_seq", "s.seq", "s.uid", "s.text", F.coalesce("s.status", F.lit("active")).alias("status"))


def sheet(spark: SparkSession, path: str, schema: str, lists: tuple[str, ...] = ()) -> DataFrame:
    """Active rows of a CSV with header; pipe lists become arrays. schema must have status."""
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False).filter(F.lower(F.trim("status")) == "active")
    return rows.withColumns({c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")) for c in lists})


def merged_points(main: DataFrame, fallback: DataFrame) -> DataFrame:
    """Id, lng, lat: the main source's where it has the id."""
    f = fallback.select("id", F.col("lng").alias("f_lng"), F.col("lat").alias("f_lat"))
    return main.join(f, "id", "full_outer").select("id", F.coalesce("lng", "f_lng").alias("lng"), F.coalesce("lat", "f_lat").alias("lat"))


def js_value(text, name: str, schema: str):
    """A Column: the JSON that a script assigns to window.name."""
    return F.from_json(F.regexp_extract(text, r"(?s)window\." + name + r"\s*=\s*(.*?);?\s*\z", 1), schema)
