"""Relation graphs: derived columns, checks, neighbourhoods, evidence, and trajectories over events."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.functions.text import confidence, short_id


def relations(rows: DataFrame, evidence: DataFrame, symmetric: tuple[str, ...]) -> DataFrame:
    """Rows (a, b, rel, source), evidence (a, b, rel, ord, uid, verdict). Adds rel_id, symmetric, the first
    evidence that is not rejected, and the confidence that follows."""
    first = evidence.filter("verdict <> 'reject'").groupBy("a", "b", "rel").agg(F.min_by("uid", "ord").alias("evidence_uid"))
    r = rows.join(first, ["a", "b", "rel"], "left")
    return r.withColumns({"rel_id": short_id(F.col("a"), F.col("b"), F.col("rel")), "symmetric": F.col("rel").isin(*symmetric).cast("int"), "confidence": confidence(F.col("source"), F.col("evidence_uid").isNotNull())})


def violations(rows: DataFrame, persons: DataFrame, rels: tuple[str, ...], inverse: dict[str, str]) -> DataFrame:
    """(rule, a, b, rel) of rows that break one."""
    out = [
        rows.groupBy("a", "b", "rel").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.lit("duplicate").alias("rule"), "a", "b", "rel"),
        rows.filter("a = b").select(F.lit("self").alias("rule"), "a", "b", "rel"),
        rows.filter(~F.col("rel").isin(*rels)).select(F.lit("vocabulary").alias("rule"), "a", "b", "rel"),
        *[rows.join(persons.select(F.col("id").alias(c)), c, "left_anti").select(F.lit("missing").alias("rule"), "a", "b", "rel") for c in ("a", "b")],
    ]
    other = F.create_map(*[F.lit(v) for kv in inverse.items() for v in kv])
    back = rows.select(F.col("b").alias("a"), F.col("a").alias("b"), F.element_at(other, F.col("rel")).alias("rel")).filter("rel is not null")
    out.append(rows.select("a", "b", "rel").join(back, ["a", "b", "rel"], "left_semi").select(F.lit("inverse").alias("rule"), "a", "b", "rel"))
    return reduce(DataFrame.unionByName, out).distinct()


def neighbourhood(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """Edges: a, b. start: node. Returns node, degree (0 to hops, the first that reaches it). Each hop joins the
    frontier with both directions; nodes already reached leave the frontier, so work stays in proportion to the
    edges touched."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("next")))
    both = both.persist()
    seen = start.select("node", F.lit(0).alias("degree"))
    frontier = start.select("node")
    for k in range(1, hops + 1):
        frontier = frontier.join(both, "node").select(F.col("next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").persist()
        seen = seen.unionByName(frontier.select("node", F.lit(k).alias("degree")))
    return seen


def with_evidence(relations: DataFrame, evidence: DataFrame, sents: DataFrame, cap: float = 0.4) -> DataFrame:
    """Relations (rel_id, evidence_uid, evidence_text, confidence), evidence (rel_id, uid), sents (uid, text,
    status). State: active if any evidence is, else that of the main one; a relation whose evidence has died falls to
    the cap."""
    look = sents.select(F.col("uid"), F.col("text").alias("now"), F.coalesce("status", F.lit("active")).alias("st"))
    any_ = evidence.join(look, "uid", "left").groupBy("rel_id").agg(F.count(F.lit(1)).alias("evidence_count"), F.max(F.coalesce(F.col("st") == "active", F.lit(False)).cast("int")).alias("alive"))
    r = relations.join(look.withColumnRenamed("uid", "evidence_uid"), "evidence_uid", "left").join(any_, "rel_id", "left")
    own = F.when(F.col("evidence_uid").isNull(), "none").when(F.col("st").isNull(), "missing").otherwise(F.col("st"))
    state = F.when(F.col("alive") == 1, "active").otherwise(own)
    r = r.withColumns({"state": state, "stale": (F.col("now").isNotNull() & (F.col("now") != F.col("evidence_text"))).cast("int"), "evidence_count": F.coalesce("evidence_count", F.lit(0).cast("long"))})
    return r.withColumn("confidence", F.when(F.col("evidence_uid").isNotNull() & (F.col("state") != "active"), F.least("confidence", F.lit(cap))).otherwise(F.col("confidence"))).drop("now", "st", "alive")


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (a, b) left when nodes without an edge in or without one out are taken away until none is left; what lies on
    a cycle stays. Each round costs a pass over the edges that remain."""
    now = edges.select("a", "b").distinct().checkpoint()
    n, before = now.count(), -1
    while n != before:
        heads, tails = now.select(F.col("a").alias("b")).distinct(), now.select(F.col("b").alias("a")).distinct()
        now = now.join(heads, "b", "left_semi").join(tails, "a", "left_semi").select("a", "b").checkpoint()
        n, before = now.count(), n
    return now


def cyclic(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves over directed edges, by paths of any length. What cannot lie on a cycle is trimmed
    first; then each round joins the pairs (a, b) so far with themselves, which doubles the length they cover, until no new
    pair appears. Rounds are checkpointed, so the plan does not grow with them."""
    sc = edges.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(edges.sparkSession))
    reach = trimmed(edges)
    n, before = reach.count(), -1
    while n != before:
        longer = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        reach = reach.unionByName(longer).distinct().checkpoint()
        n, before = reach.count(), n
    return reach.filter("a = b").select("a")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or "file://" + tempfile.mkdtemp(prefix="inkspan-")


def conflicts(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) for which two relations or more are stated, with these. edges: a, b, rel."""
    return edges.groupBy("a", "b").agg(F.sort_array(F.collect_set("rel")).alias("rels")).filter(F.size("rels") > 1)


def carried(events: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """The last known value before or at each row; inherited says whether it is the row's own."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("carried", F.last(value, ignorenulls=True).over(w)).withColumn("inherited", F.col(value).isNull() & F.col("carried").isNotNull())


def stations(events: DataFrame, person: str, place: str, year: str, order: str) -> DataFrame:
    """The first visit of each person to each place; dated ones numbered by year, undated ones 0 and last."""
    first = events.withColumn("k", F.row_number().over(Window.partitionBy(person, place).orderBy(order))).filter("k = 1").drop("k")
    n = F.row_number().over(Window.partitionBy(person, F.col(year).isNull()).orderBy(year, order))
    return first.withColumn("time_order", F.when(F.col(year).isNull(), 0).otherwise(n))


def hubs(visits: DataFrame, zones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Visits to hubs, and hub connections (zones: place, zone, connections) whose both ends are hubs."""
    links = zones.select("place", F.explode("connections").alias("other")).join(zones.select(F.col("place").alias("other")), "other", "left_semi")
    return visits.join(zones.select("place", "zone"), "place"), links.select(F.least("place", "other").alias("a"), F.greatest("place", "other").alias("b")).distinct()


def evidence_score(text: Column, name_a: Column, name_b: Column, words: tuple[str, ...], third: Column) -> Column:
    """5 both names and a word of the relation, 3 both names, 1 one of them, else 0; a third person or a long
    sentence makes it 2 at most."""
    a, b = F.contains(text, name_a), F.contains(text, name_b)
    score = F.when(a & b & text.rlike("|".join(words)), 5).when(a & b, 3).when(a | b, 1).otherwise(0)
    return F.when(third | (F.length(text) > 24), F.least(score, F.lit(2))).otherwise(score)


def mined(persons: DataFrame, pattern: str) -> DataFrame:
    """Candidates from summaries: pattern has the relation in group 1 and the other's name in group 2."""
    hit = persons.select(F.col("id").alias("a"), F.explode(F.regexp_extract_all("summary", F.lit(pattern), F.lit(0))).alias("m"))
    hit = hit.select("a", F.regexp_extract("m", pattern, 1).alias("rel"), F.regexp_extract("m", pattern, 2).alias("name"))
    return hit.join(persons.select(F.col("id").alias("b"), "name"), "name").filter("a <> b").groupBy("a", "rel", "name").agg(F.sort_array(F.collect_set("b")).alias("candidates"))


def accepted(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (a, rel, candidates) with the reason they are skipped for, or null."""
    have = known.select("a", "rel", F.lit(1).alias("have")).distinct()
    return candidates.join(have, ["a", "rel"], "left").withColumn("skip", F.when(F.size("candidates") > 1, "several").when(F.col("have").isNotNull(), "known")).drop("have")
