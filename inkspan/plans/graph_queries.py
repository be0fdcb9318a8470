"""Relation graphs over customers, suppliers and parts; trajectories over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.functions import text as t
from inkspan.operators import graph
from inkspan.sources import sinks

from . import model as m
from .registry import query

EDGE_SQL = "e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem)"


def edges(spark, d):
    """Two kinds of nodes, told apart by sign."""
    return m.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (-F.col("l_partkey")).alias("b")).distinct()


@query(
    "WITH RECURSIVE " + EDGE_SQL + ", links AS (SELECT a AS x, -b AS y FROM e UNION ALL SELECT -b, a FROM e), r(node, degree) AS (SELECT 1::BIGINT, 0 UNION SELECT y, degree + 1 FROM r JOIN links ON x = node WHERE degree < 3) SELECT node, min(degree)::INT AS degree FROM r GROUP BY node"
)
def graph_khop(spark, d):
    """D17, J9."""
    return graph.neighbourhood(edges(spark, d), spark.range(1, 2).select(F.col("id").alias("node")), 3)


REL = "r AS (SELECT l_suppkey AS a, l_partkey AS b, CASE WHEN l_linenumber = 1 THEN 'friend' ELSE 'rival' END AS rel, max(CASE l_returnflag WHEN 'A' THEN 'manual' WHEN 'N' THEN 'ai' ELSE 'other' END) AS source FROM lineitem GROUP BY 1, 2, 3)"


def rels(spark, d):
    li = m.table(spark, d, "lineitem")
    source = F.when(F.col("l_returnflag") == "A", "manual").when(F.col("l_returnflag") == "N", "ai").otherwise("other")
    return li.groupBy(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.when(F.col("l_linenumber") == 1, "friend").otherwise("rival").alias("rel")).agg(F.max(source).alias("source"))


@query("WITH " + REL + ", ev AS (SELECT l_suppkey AS a, l_partkey AS b, CASE WHEN l_linenumber = 1 THEN 'friend' ELSE 'rival' END AS rel, l_orderkey AS ord, l_orderkey::VARCHAR AS uid FROM lineitem WHERE l_linestatus <> 'O'), f AS (SELECT a, b, rel, arg_min(uid, ord) AS evidence_uid FROM ev GROUP BY 1, 2, 3) SELECT r.a, r.b, r.rel, r.source, f.evidence_uid, substr(md5(r.a || '|' || r.b || '|' || r.rel), 1, 12) AS rel_id, (r.rel = 'friend')::INT AS symmetric, CASE WHEN f.evidence_uid IS NULL THEN 0.4 ELSE CASE r.source WHEN 'manual' THEN 1.0 WHEN 'ai' THEN 0.8 ELSE 0.4 END END::DOUBLE AS confidence FROM r LEFT JOIN f USING (a, b, rel)")
def relations_apply(spark, d):
    """D15, U6."""
    li = m.table(spark, d, "lineitem")
    ev = li.select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"), F.when(F.col("l_linenumber") == 1, "friend").otherwise("rival").alias("rel"), F.col("l_orderkey").alias("ord"), F.col("l_orderkey").cast("string").alias("uid"), F.when(F.col("l_linestatus") == "O", "reject").otherwise("accept").alias("verdict"))
    return graph.relations(rels(spark, d), ev, ("friend",)).select("a", "b", "rel", "source", "evidence_uid", "rel_id", "symmetric", "confidence")


@query(
    "WITH r AS (SELECT c_custkey % 50 AS a, c_nationkey::BIGINT AS b, CASE c_custkey % 4 WHEN 0 THEN 'father' WHEN 1 THEN 'son' WHEN 2 THEN 'friend' ELSE 'odd' END AS rel FROM customer), dup AS (SELECT 'duplicate' AS rule, a, b, rel FROM r GROUP BY a, b, rel HAVING count(*) > 1) "
    "SELECT * FROM dup UNION SELECT 'self', a, b, rel FROM r WHERE a = b UNION SELECT 'vocabulary', a, b, rel FROM r WHERE rel NOT IN ('father', 'son', 'friend') UNION SELECT 'missing', a, b, rel FROM r WHERE a >= 40 OR b >= 40 UNION SELECT 'inverse', a, b, rel FROM r WHERE EXISTS (SELECT 1 FROM r q WHERE q.a = r.b AND q.b = r.a AND ((r.rel = 'father' AND q.rel = 'son') OR (r.rel = 'son' AND q.rel = 'father')))"
)
def relations_check(spark, d):
    """D16."""
    k = F.col("c_custkey") % 4
    r = m.table(spark, d, "customer").select((F.col("c_custkey") % 50).alias("a"), F.col("c_nationkey").cast("long").alias("b"), F.when(k == 0, "father").when(k == 1, "son").when(k == 2, "friend").otherwise("odd").alias("rel"))
    return graph.violations(r, spark.range(40), ("father", "son", "friend"), {"father": "son", "son": "father"})


@query(
    "WITH o AS (SELECT o_orderkey::VARCHAR AS uid, o_orderstatus || '' AS now, CASE WHEN o_orderstatus = 'F' THEN 'dead' ELSE 'active' END AS st FROM orders), ev AS (SELECT DISTINCT l_partkey AS rel_id, l_orderkey::VARCHAR AS uid FROM lineitem), "
    "r AS (SELECT p_partkey AS rel_id, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE (p_partkey * 7)::VARCHAR END AS evidence_uid, 'O' AS evidence_text, 0.8::DOUBLE AS confidence FROM part), g AS (SELECT rel_id, count(*)::BIGINT AS evidence_count, max((coalesce(st = 'active', false))::INT) AS alive FROM ev LEFT JOIN o USING (uid) GROUP BY rel_id), "
    "x AS (SELECT r.rel_id, r.confidence, r.evidence_uid, coalesce(g.evidence_count, 0)::BIGINT AS evidence_count, CASE WHEN g.alive = 1 THEN 'active' WHEN r.evidence_uid IS NULL THEN 'none' WHEN o.st IS NULL THEN 'missing' ELSE o.st END AS state, (o.now IS NOT NULL AND o.now <> r.evidence_text)::INT AS stale FROM r LEFT JOIN o ON o.uid = r.evidence_uid LEFT JOIN g ON g.rel_id = r.rel_id) "
    "SELECT rel_id, evidence_count, state, stale, CASE WHEN evidence_uid IS NOT NULL AND state <> 'active' THEN least(confidence, 0.4) ELSE confidence END AS confidence FROM x"
)
def evidence_state(spark, d):
    """D18, P13."""
    o = m.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("uid"), F.col("o_orderstatus").alias("text"), F.when(F.col("o_orderstatus") == "F", "dead").otherwise("active").alias("status"))
    ev = m.table(spark, d, "lineitem").select(F.col("l_partkey").alias("rel_id"), F.col("l_orderkey").cast("string").alias("uid")).distinct()
    k = F.col("p_partkey")
    r = m.table(spark, d, "part").select(k.alias("rel_id"), F.when(k % 5 != 0, (k * 7).cast("string")).alias("evidence_uid"), F.lit("O").alias("evidence_text"), F.lit(0.8).alias("confidence"))
    return graph.with_evidence(r, ev, o).select("rel_id", "evidence_count", "state", "stale", "confidence")


@query("WITH RECURSIVE e AS (SELECT DISTINCT c_nationkey AS a, (c_custkey % 25)::INT AS b FROM customer), p(a, b) AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT DISTINCT a FROM p WHERE a = b")
def genealogy_cycles(spark, d):
    """D22."""
    e = m.table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).cast("int").alias("b"))
    return graph.cyclic(e)


@query("SELECT c_nationkey AS a, (c_custkey % 25)::INT AS b, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS rels FROM customer GROUP BY 1, 2 HAVING count(DISTINCT c_mktsegment) > 1")
def genealogy_conflicts(spark, d):
    """Pairs with two generations' relations at once."""
    r = m.table(spark, d, "customer").select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).cast("int").alias("b"), F.col("c_mktsegment").alias("rel"))
    return graph.conflicts(r).select("a", "b", F.concat_ws(",", "rels").alias("rels"))


YEAR = "CASE WHEN event_id % 4 = 0 THEN NULL ELSE (value * 10)::INT END"


def visits(spark, d):
    return m.table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.when(F.col("event_id") % 4 != 0, F.round(F.col("value") * 10).cast("int")).alias("year"))


E_SQL = "ev AS (SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 4 <> 0 THEN round(value * 10)::INT END AS year FROM events)"


@query("WITH " + E_SQL + ", c AS (SELECT event_id, year, last_value(year IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM ev) SELECT event_id, carried, year IS NULL AND carried IS NOT NULL AS inherited FROM c")
def trajectory_carry_forward(spark, d):
    """W3."""
    return graph.carried(visits(spark, d), ["user_id"], ["ts", "event_id"], "year").select("event_id", "carried", "inherited")


@query("WITH " + E_SQL + ", f AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM ev) SELECT user_id, event_type, event_id, CASE WHEN year IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY user_id, year IS NULL ORDER BY year, event_id) END::INT AS time_order FROM f WHERE k = 1")
def trajectory_order(spark, d):
    """W4, W5, O4, D23."""
    return graph.stations(visits(spark, d), "user_id", "event_type", "year", "event_id").select("user_id", "event_type", "event_id", "time_order")


@query("WITH " + E_SQL + " SELECT user_id, count(*)::BIGINT AS n, count(year)::BIGINT AS n_dated, sum(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END)::BIGINT AS n_placed FROM ev GROUP BY user_id")
def trajectory_stats(spark, d):
    """A17."""
    return visits(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("year").alias("n_dated"), F.count_if(F.col("event_type").isin("click", "view")).alias("n_placed"))


@query("WITH " + E_SQL + ", g AS (SELECT user_id, year, count(DISTINCT event_type) > 1 AS many FROM ev WHERE year IS NOT NULL GROUP BY 1, 2) SELECT event_id, coalesce(many, false) AS many FROM ev LEFT JOIN g USING (user_id, year)")
def same_year_multi_place(spark, d):
    """K8, A17."""
    v = visits(spark, d).select("event_id", F.col("user_id").alias("person"), F.col("event_type").alias("place"), "year")
    return sinks.same_year_many_places(v).select("event_id", "many")


@query("SELECT 1::BIGINT AS id, '建元三年春' AS raw, -138 AS year UNION ALL SELECT 2, '永平元年', 58 UNION ALL SELECT 3, '至某某五年', NULL UNION ALL SELECT 4, NULL, NULL")
def time_parse(spark, d):
    """F14; the era map is given as rows of one book."""
    rows = spark.createDataFrame([(1, "建元三年春，上幸雍"), (2, "永平元年。"), (3, "至某某五年，"), (4, "無年")], "id long, text string")
    y = t.parse_year(F.col("text"), {"建元": -140, "永平": 58}, {"元": 1, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5}, ("是歲", "是年", "及", "至", "時", "秋", "冬", "春", "夏", "後"))
    return rows.withColumn("y", y).select("id", "y.raw", "y.year")


@query(m.MP + ", v AS (SELECT DISTINCT uid, id AS place FROM pment), z AS (SELECT * FROM " + m.values([("l01", "north"), ("l03", "south")], "place, zone") + ") SELECT z.zone, place, count(*)::BIGINT AS n FROM v JOIN z USING (place) GROUP BY 1, 2")
def strategic_hubs(spark, d):
    """D24."""
    zones = spark.createDataFrame([("l01", "north", ["l03", "l02"]), ("l03", "south", ["l01"])], "place string, zone string, connections array<string>")
    v = m.mentions(spark, d, m.PLACES).select("uid", F.col("id").alias("place")).distinct()
    return graph.hubs(v, zones)[0].groupBy("zone", "place").agg(F.count(F.lit(1)).alias("n"))


@query("WITH " + m.SENT_SQL + ", s AS (SELECT uid, contains(text, 'that') AS a, contains(text, 'with') AS b, regexp_matches(text, 'and|for') AS w, contains(text, 'ther') AS third, length(text) > 24 AS long FROM sent), x AS (SELECT uid, CASE WHEN a AND b AND w THEN 5 WHEN a AND b THEN 3 WHEN a OR b THEN 1 ELSE 0 END AS raw, third OR long AS worse FROM s) SELECT uid, CASE WHEN worse THEN least(raw, 2) ELSE raw END AS score FROM x")
def evidence_score(spark, d):
    """D20."""
    s = m.sentences(spark, d)
    x = F.col("text")
    return s.select("uid", graph.evidence_score(x, F.lit("that"), F.lit("with"), ("and", "for"), F.contains(x, F.lit("ther"))).alias("score"))


@query(
    "WITH p AS (SELECT c_custkey::VARCHAR AS id, c_name AS name, 'friend of Customer#' || lpad((c_custkey % 100 + 1)::VARCHAR, 9, '0') AS summary FROM customer), h AS (SELECT id AS a, regexp_extract(summary, '(friend) of (Customer#[0-9]+)', 1) AS rel, regexp_extract(summary, '(friend) of (Customer#[0-9]+)', 2) AS name FROM p) SELECT h.a, h.rel, h.name, string_agg(p.id, ',' ORDER BY p.id) AS candidates, CASE WHEN count(*) > 1 THEN 'several' WHEN h.a::BIGINT % 3 = 0 THEN 'known' END AS skip FROM h JOIN p USING (name) WHERE h.a <> p.id GROUP BY 1, 2, 3"
)
def relation_mining(spark, d):
    """D19, D21, J17."""
    p = m.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("friend of Customer#"), F.lpad((F.col("c_custkey") % 100 + 1).cast("string"), 9, "0")).alias("summary"))
    known = m.table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("a"), F.lit("friend").alias("rel"))
    got = graph.accepted(graph.mined(p, "(friend) of (Customer#[0-9]+)"), known)
    return got.select("a", "rel", "name", F.concat_ws(",", "candidates").alias("candidates"), "skip")


@query("SELECT n_name AS name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name")
def dimension_lookup(spark, d):
    """Counts first, names joined to the short result."""
    c = m.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(m.table(spark, d, "nation"), "n_nationkey").join(m.table(spark, d, "region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select(F.col("n_name").alias("name"), "n")


