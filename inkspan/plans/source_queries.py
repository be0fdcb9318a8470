"""Sources and sinks as queries: round trips through the shared scratch folder, and merges of side files."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.sources import readers

from . import model as m
from .registry import query


@query("SELECT user_id AS id, avg(value) AS lng, 1.0::DOUBLE AS lat FROM events WHERE user_id % 2 = 0 GROUP BY user_id UNION ALL SELECT user_id, 0.0, 0.0 FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 1)")
def merged_points(spark, d):
    """S12."""
    e = m.table(spark, d, "events")
    main = e.filter("user_id % 2 = 0").groupBy(F.col("user_id").alias("id")).agg(F.avg("value").alias("lng"), F.lit(1.0).alias("lat"))
    return readers.merged_points(main, e.select(F.col("user_id").alias("id"), F.lit(0.0).alias("lng"), F.lit(0.0).alias("lat")).distinct())


@query("SELECT DISTINCT CASE WHEN p_partkey % 7 = 0 THEN p_brand ELSE p_name END AS title FROM part")
def redirect_dedupe(spark, d):
    """S3."""
    p = m.table(spark, d, "part")
    return readers.canonical(p.select(F.concat(F.col("p_partkey").cast("string"), F.lit("|"), "p_name").alias("title")), p.select(F.concat(F.col("p_partkey").cast("string"), F.lit("|"), "p_name").alias("title"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("target")))


@query("SELECT page_id FROM pages WHERE NOT (length(html) > 2000 AND page_id % 2 = 0)")
def resumable_fetch(spark, d):
    """S4."""
    p = m.table(spark, d, "pages")
    landed = p.filter("page_id % 2 = 0").select(F.col("page_id").alias("name"), F.length("html").alias("size"))
    return readers.to_fetch(p.select(F.col("page_id").alias("name")), landed, 2000).select(F.col("name").alias("page_id"))


@query("SELECT event_id, event_type AS kind FROM events")
def js_wrapped_json(spark, d):
    """S14."""
    s = m.table(spark, d, "events").select("event_id", F.concat(F.lit('window.DATA = {"k": "'), "event_type", F.lit('"};\n')).alias("script"))
    return s.select("event_id", readers.js_value(F.col("script"), "DATA", "k string").getField("k").alias("kind"))
