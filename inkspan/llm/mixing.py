"""Mixing sources to target weights.

Words are summed for each source (partial sums before the shuffle, so a hot source costs one row a task), repetition
rates come from the sums, and each document is emitted floor(rate) times plus once more by a draw with probability equal to
the fraction, seeded by a hash of its doc_id. Independent draws would miss the target of a source with few long documents, so
a source's draws share one threshold: not the fraction itself, but the hash up to which its documents' words reach the
fraction of its words. One more document, the one whose size is nearest to the words still missing, closes the gap. The
threshold is found in two steps: words are summed by source and slice of the hash's range, and only the documents of the slice
in which the sum passes the target are put in order. The table of sources is joined by Spark's own choice: it is
broadcast only while its measured size is under the session's threshold, else the join shuffles and AQE splits a hot
source.

Targets: sources share budget times all words by weight; a target stops at cap times the source's words and the rest
is reshared by weight until none is above. That is water filling, solved in closed form: in ascending order of
cap * words / weight the sources up to some place stop at their caps, and all after it get the same share per weight.

Null text counts no words. Null source: a source of its own, last in order. Null doc_id hashes like the word null. Rows that
share a doc_id have one hash, so of one source they are drawn together. A source without words has target 0. Empty table: empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, cut

WEIGHTS = (3, 1, 2)
BUDGET = (3, 2)  # of all words, as a fraction
CAP = 2
#: Slices of the hash's range.
SLICES = 1 << 14


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: tuple[int, int] = BUDGET, cap: int = CAP) -> DataFrame:
    """sizes: source, size, a row for each document. Returns source, source_size, target: a row for each source."""
    num, den = budget
    # from here on there is a row for each source, few even where documents are many: one task orders them
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("long"))
    by = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    s = (
        s.withColumn("capped", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("all", F.sum("source_size").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    # words per weight, times open * den, if this source were the first below its cap
    s = s.withColumn("share", F.col("all") * num - F.col("capped") * den)
    stops = F.col("source_size") * cap * F.col("open") * den <= F.col("share") * F.col("weight")
    s = s.withColumn("stops", stops)
    first = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), "share", "open"))).over(Window.partitionBy(F.lit(0)))
    s = s.withColumn("level", first)
    target = F.when(F.col("stops"), (F.col("source_size") * cap).cast("double")).otherwise((F.col("weight") * F.col("level.share")).cast("double") / (F.col("level.open") * den).cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def chance(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) from a hash, the same at each run and in each engine that has md5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def draws(rows: DataFrame, **how) -> DataFrame:
    """rows: source, size, chance. Returns a row for each source: goal_source, source_size, target, copies (that each document
    gets), below, upto and fill: a document with a chance under below, up to upto, or equal to fill gets one more."""
    goal = targets(rows.select("source", "size"), **how)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("copies", F.floor(rate)).withColumn("extra", F.col("target") - F.col("copies") * F.col("source_size")).withColumnRenamed("source", "goal_source")
    goal = cut(goal, "goals")
    same = F.col("source").eqNullSafe(F.col("goal_source"))
    slices = rows.groupBy("source", F.floor(F.col("chance") * SLICES).alias("slice")).agg(F.sum("size").alias("size"))
    passed = F.sum("size").over(Window.partitionBy("source").orderBy("slice"))
    slices = slices.withColumn("passed", passed).join(goal, same).filter(F.col("passed") > F.col("extra"))
    edge = slices.groupBy("goal_source").agg(F.min(F.struct("slice", (F.col("passed") - F.col("size")).alias("before"))).alias("at"))
    goal = goal.join(edge.withColumnRenamed("goal_source", "edge_source"), F.col("goal_source").eqNullSafe(F.col("edge_source")), "left")
    total = F.when(F.col("at").isNull(), F.col("source_size")).otherwise(F.col("at.before"))
    goal = cut(goal.select("goal_source", "source_size", "target", "copies", "extra", "at.slice", F.coalesce(F.col("at.slice") / SLICES, F.lit(1.0)).alias("below"), total.alias("before")), "edges")
    # the few documents of the slice in which a source's sum passes its target
    near = rows.join(goal, same & (F.floor(F.col("chance") * SLICES) == F.col("slice")))
    near = near.withColumn("sum", F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("chance"))).filter(F.col("sum") <= F.col("extra"))
    last = near.groupBy(F.col("source").alias("last_source")).agg(F.max("chance").alias("upto"), F.max("sum").alias("sum"))
    goal = goal.join(last, F.col("goal_source").eqNullSafe(F.col("last_source")), "left")
    goal = cut(goal.select("goal_source", "source_size", "target", "copies", "below", "upto", (F.col("extra") - F.coalesce("sum", "before")).alias("rest")), "limits")
    gap = F.abs(F.col("rest") - F.col("size"))
    others = rows.join(goal, same).filter(~_drawn(F.lit(None)) & (F.col("size") > 0) & (gap < F.col("rest")))
    fill = others.groupBy(F.col("source").alias("fill_source")).agg(F.min(F.struct(gap.alias("gap"), "chance"))["chance"].alias("fill"))
    goal = goal.join(fill, F.col("goal_source").eqNullSafe(F.col("fill_source")), "left")
    return cut(goal.select("goal_source", "source_size", "target", "copies", "below", "upto", "fill"), "draws")


def _drawn(fill: Column) -> Column:
    """Whether the row's chance gives it one more copy."""
    return (F.col("chance") < F.col("below")) | F.coalesce(F.col("chance") <= F.col("upto"), F.lit(False)) | F.coalesce(F.col("chance") == fill, F.lit(False))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size"))
    return cut(rows.withColumn("chance", chance(F.col("doc_id"), seed)), "sizes")  # four short columns, so that texts are read once


def copies(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target, n_copies."""
    rows = _sized(docs, seed)
    rows = rows.join(draws(rows, **how), F.col("source").eqNullSafe(F.col("goal_source")), "left")
    n = F.col("copies") + _drawn(F.col("fill")).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", n.cast("long").alias("n_copies"))


def mix(docs: DataFrame, seed: str = "mix", **how) -> DataFrame:
    """The mixed corpus: each document's row with all its columns, as often as it is taken."""
    goal = draws(_sized(docs, seed), **how)
    row, own = F.struct(*[F.col(c) for c in docs.columns]), ("goal_source", "copies", "below", "upto", "fill")
    rows = docs.select(row.alias("row"), F.col("source").cast("string").alias("source"), chance(F.col("doc_id").cast("long"), seed).alias("chance"))
    rows = rows.join(goal.select(*own), F.col("source").eqNullSafe(F.col("goal_source")), "left")
    n = (F.col("copies") + _drawn(F.col("fill")).cast("long")).cast("int")
    rows = rows.withColumn("n", n).filter("n > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def taken(docs: DataFrame) -> DataFrame:
    return copies(docs).select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).alias("taken"))


TAKEN_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS weight FROM s),
o AS (SELECT *, coalesce(sum(source_size * 2) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped,
      sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open,
      sum(source_size) OVER ()::BIGINT AS total FROM w),
p AS (SELECT *, total * 3 - capped * 2 AS share, source_size * 2 * open * 2 <= (total * 3 - capped * 2) * weight AS stops FROM o),
f AS (SELECT share AS level_share, open AS level_open FROM p WHERE NOT stops ORDER BY source_size / weight, share, open LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stops THEN (source_size * 2)::DOUBLE ELSE (weight * level_share)::DOUBLE / (level_open * 2)::DOUBLE END AS target FROM p LEFT JOIN f ON true),
r AS (SELECT d.*, t.source_size, t.target, floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END) AS copies,
      ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS chance
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, target - copies * source_size AS extra, sum(size) OVER (PARTITION BY source ORDER BY chance) AS upto FROM r),
k AS (SELECT *, extra - sum(CASE WHEN upto <= extra THEN size ELSE 0 END) OVER (PARTITION BY source) AS rest FROM c),
x AS (SELECT source, chance FROM k WHERE upto > extra AND size > 0 AND abs(rest - size) < rest QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(rest - size), chance) = 1)
SELECT k.doc_id, k.size, k.source_size, k.target, ((k.copies + CASE WHEN upto <= extra OR x.chance IS NOT NULL THEN 1 ELSE 0 END) * k.size)::BIGINT AS taken
FROM k LEFT JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.chance = x.chance
"""
