"""Snapshots, overrides, edits, reconciliation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkspan.operators import audit, versions
from inkspan.sources import sinks

from . import model as m
from .registry import query


def snapshot(spark, d, version: int):
    """lineitem as mentions; the second version drops, adds and changes some by arithmetic on the keys."""
    k = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    r = m.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("uid"), F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + 1).alias("e"), F.col("l_returnflag").alias("surface"), F.col("l_partkey").alias("id"), F.col("l_linestatus").alias("tier"), k.alias("k"))
    if version == 1:
        return r.filter("k % 17 <> 0").drop("k")
    r = r.filter("k % 19 <> 0").withColumn("id", F.when(F.col("k") % 23 == 0, F.col("id") + 1).otherwise(F.col("id")))
    return r.withColumn("tier", F.when(F.col("k") % 29 == 0, "X").otherwise(F.col("tier"))).drop("k")


SNAP = """b AS (SELECT l_orderkey AS uid, l_linenumber AS s, l_linenumber + 1 AS e, l_returnflag AS surface, l_partkey AS id, l_linestatus AS tier, l_orderkey * 8 + l_linenumber AS k FROM lineitem),
o AS (SELECT * FROM b WHERE k % 17 <> 0), n AS (SELECT uid, s, e, surface, CASE WHEN k % 23 = 0 THEN id + 1 ELSE id END AS id, CASE WHEN k % 29 = 0 THEN 'X' ELSE tier END AS tier FROM b WHERE k % 19 <> 0)"""



@query(f"WITH {SNAP}, j AS (SELECT coalesce(n.uid, o.uid) AS uid, coalesce(n.s, o.s) AS s, o.id AS old_id, n.id AS new_id, CASE WHEN o.uid IS NULL THEN 'added' WHEN n.uid IS NULL THEN 'removed' WHEN o.id <> n.id THEN 'pid_changed' WHEN o.tier <> n.tier THEN 'tier_changed' END AS kind FROM n FULL JOIN o ON n.uid = o.uid AND n.s = o.s AND n.e = o.e AND n.surface = o.surface) SELECT * FROM j WHERE kind IS NOT NULL")
def snapshot_diff(spark, d):
    """J8, D14."""
    return versions.diff(snapshot(spark, d, 1), snapshot(spark, d, 2)).select("uid", "s", "old_id", "new_id", "kind")


@query("WITH k AS (SELECT DISTINCT date_trunc('day', ts) AS snapshot_id FROM events ORDER BY 1 DESC LIMIT 5) SELECT event_id FROM events WHERE date_trunc('day', ts) IN (SELECT snapshot_id FROM k)")
def snapshot_retention(spark, d):
    """W6, D13."""
    e = m.table(spark, d, "events").select("event_id", F.date_trunc("day", "ts").alias("snapshot_id"))
    return versions.retained(e, 5).select("event_id")


E_SQL = "b AS (SELECT user_id AS uid, event_id AS s, event_id + 1 AS e, event_type AS surface, event_id % 50 AS id FROM events)"


def event_mentions(spark, d):
    return m.table(spark, d, "events").select(F.col("user_id").alias("uid"), F.col("event_id").alias("s"), (F.col("event_id") + 1).alias("e"), F.col("event_type").alias("surface"), (F.col("event_id") % 50).alias("id"))


@query(f"WITH {E_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY uid, surface ORDER BY s) AS nth FROM b) SELECT uid, s, CASE WHEN nth = 1 AND uid % 5 = 1 THEN 0 ELSE id END AS id, (nth = 1 AND uid % 5 < 3)::INT AS overridden FROM r WHERE NOT (nth = 1 AND uid % 5 = 0)")
def override_apply(spark, d):
    """One override for the first of each surface: by exact span for odd users, by place for even ones."""
    ment = event_mentions(spark, d)
    k, odd = F.col("uid") % 5, F.col("uid") % 2 == 1
    o = ment.groupBy("uid", "surface").agg(F.min("s").alias("s")).filter(k < 3)
    o = o.select("uid", F.when(odd, F.col("s")).otherwise(-1).alias("s"), (F.when(odd, F.col("s")).otherwise(-2) + 1).alias("e"), "surface", F.lit(1).alias("nth"), F.when(k == 0, "drop").when(k == 1, "reassign").otherwise("keep").alias("action"), F.lit(0).cast("long").alias("new_id"))
    return versions.overridden(ment, o).select("uid", "s", "id", "overridden")


@query(f"WITH {E_SQL}, n AS (SELECT uid, s, e, surface, CASE WHEN s % 23 = 0 THEN id + 1 ELSE id END AS id FROM b WHERE s % 19 <> 0), ov AS (SELECT uid, s, e, surface, CASE s % 3 WHEN 0 THEN 'drop' WHEN 1 THEN 'keep' ELSE 'reassign' END AS action, CASE WHEN s % 2 = 0 THEN id + 1 ELSE id END AS new_id FROM b WHERE s % 23 < 2), j AS (SELECT ov.*, n.id AS now FROM ov LEFT JOIN n USING (uid, s, e, surface)) SELECT uid, s, CASE WHEN action = 'drop' THEN CASE WHEN now IS NULL THEN 'applied' ELSE 'pending' END WHEN now IS NULL THEN 'lost' WHEN action = 'keep' THEN 'applied' WHEN now = new_id THEN 'applied' ELSE 'pending' END AS state FROM j")
def override_states(spark, d):
    """persons' and places' mentions, united."""
    base, k = event_mentions(spark, d), F.col("s")
    now = base.filter(k % 19 != 0).withColumn("id", F.when(k % 23 == 0, F.col("id") + 1).otherwise(F.col("id")))
    both = now.filter("uid % 2 = 0").unionByName(now.filter("uid % 2 = 1"))
    ov = base.filter(k % 23 < 2).select("uid", "s", "e", "surface", F.when(k % 3 == 0, "drop").when(k % 3 == 1, "keep").otherwise("reassign").alias("action"), F.when(k % 2 == 0, F.col("id") + 1).otherwise(F.col("id")).alias("new_id"))
    return versions.override_states(ov, both).select("uid", "s", "state")


@query()
def edit_replay(spark, d):
    """Splits, merges and dead sentences from the pristine text."""
    s = m.sentences(spark, d)
    k = F.conv(F.substring("uid", 1, 6), 16, 10).cast("int")
    e = s.select("uid", k.alias("edit_id")).filter(F.col("edit_id") % 40 < 3).select("edit_id", "uid", F.element_at(F.array(F.lit("split"), F.lit("merge"), F.lit("dead")), (F.col("edit_id") % 40 + 1).cast("int")).alias("action"), F.lit(5).alias("at"))
    return versions.replayed(s, e)


@query("WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def set_reconcile(spark, d):
    """U3, U4, J18."""
    o = m.table(spark, d, "orders")
    return versions.reconciled(o.filter("o_orderkey % 3 <> 0").select("o_custkey", "o_orderstatus"), o.filter("o_orderkey % 4 <> 0").select("o_custkey", "o_orderstatus"))


@query("WITH " + m.SENT_SQL + " SELECT chapter, para_seq::INT AS para_seq, seq::INT AS seq, CASE WHEN chapter % 3 = 0 THEN 'own' WHEN chapter % 3 = 1 THEN 'old' ELSE uid END AS uid FROM sent")
def reuse_uids(spark, d):
    """S13."""
    s = m.sentences(spark, d)
    c = s.select("chapter", "para_seq", "seq", F.when(F.col("chapter") % 3 == 0, "own").alias("uid"))
    old = s.filter("chapter % 3 <> 2").select("chapter", "para_seq", "seq", F.lit("old").alias("uid"))
    return versions.kept_uids(c, old)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 10 = 0 THEN l_partkey + 1000000 ELSE l_partkey END AS l_partkey, CASE WHEN l_suppkey % 10 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS l_suppkey FROM lineitem")
def id_rename(spark, d):
    """D28."""
    m_ = m.table(spark, d, "part").filter("p_partkey % 10 = 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1000000).alias("new"))
    return versions.renamed(m.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), m_, ["l_partkey", "l_suppkey"])


@query("SELECT o_custkey, max_by(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def last_write_wins(spark, d):
    """K3."""
    return sinks.last_wins(m.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


@query("WITH l AS (SELECT event_type AS key, count(*)::BIGINT AS n FROM events GROUP BY 1), x AS (SELECT event_type AS key, count(*)::BIGINT AS exported FROM events WHERE event_id % 100 <> 0 GROUP BY 1) SELECT key, n, exported FROM l FULL JOIN x USING (key) WHERE CASE WHEN key = 'click' THEN exported > n ELSE exported <> n END")
def export_staleness(spark, d):
    """K10."""
    e = m.table(spark, d, "events")
    count = lambda x: x.groupBy(F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sinks.stale(count(e), count(e.filter("event_id % 100 <> 0")), ("click",)).select("key", "n", "exported")


@query("WITH s AS (SELECT c_nationkey, c_custkey, c_name FROM customer) SELECT 'n' || c_nationkey AS title, '## n' || c_nationkey || chr(10) || chr(10) || string_agg('- ' || c_name, chr(10) ORDER BY c_custkey) AS value FROM s GROUP BY c_nationkey")
def markdown_sheets(spark, d):
    """K11."""
    return sinks.markdown(m.table(spark, d, "customer"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_name"), ["c_custkey"])


@query(m.M + ", s AS (SELECT uid, row_number() OVER (ORDER BY chapter, para_seq, seq) - 1 AS k FROM sent) SELECT id, md5('[' || string_agg('[' || k || ',' || nth || ']', ',' ORDER BY k, nth) || ']') AS digest FROM ment JOIN s USING (uid) GROUP BY id")
def static_export(spark, d):
    """K5: mentions with the sentences' ordinals."""
    s = m.sentences(spark, d)
    return sinks.encoded(m.find_mentions(s, m.surfaces(m.PERSONS)), s).select("id", F.md5("block").alias("digest"))


@query("WITH a AS (SELECT 'p' || (c_custkey % 200) AS id, c_mktsegment || (c_custkey % 37) AS alias FROM customer) SELECT alias, string_agg(DISTINCT id, ',' ORDER BY id) AS owners FROM a GROUP BY alias HAVING count(DISTINCT id) > 1")
def alias_conflicts(spark, d):
    """A27."""
    e = m.table(spark, d, "customer").select(F.concat(F.lit("p"), (F.col("c_custkey") % 200).cast("string")).alias("id"), F.array(F.concat("c_mktsegment", (F.col("c_custkey") % 37).cast("string"))).alias("aliases"))
    return audit.alias_conflicts(e).select("alias", F.concat_ws(",", "owners").alias("owners"))


@query(m.M + " SELECT surface, count(*)::BIGINT AS n, count(*) FILTER (nth > 2)::BIGINT AS n_guess, count(*) FILTER (nth > 2)::DOUBLE / count(*) AS ratio FROM ment GROUP BY surface")
def guess_ratio(spark, d):
    """A20."""
    return audit.guess_ratio(m.mentions(spark, d).withColumn("tier", F.when(F.col("nth") > 2, "guess").otherwise("core")))


HOME = [("p01", "src0"), ("p02", "src1"), ("p03", "src0"), ("p03", "src1"), ("p06", "src3")]


@query(m.M + f", x AS (SELECT surface, m.id, count(h.book)::BIGINT AS n_native, count(*) FILTER (h.book IS NULL)::BIGINT AS n_foreign FROM ment m LEFT JOIN {m.values(HOME, 'id, book')} h ON h.id = m.id AND h.book = m.book GROUP BY 1, 2) SELECT * FROM x WHERE n_foreign >= 4 AND n_foreign >= 0.35 * (n_native + n_foreign)")
def ambiguity_audit(spark, d):
    """A21."""
    return audit.ambiguity(m.mentions(spark, d), spark.createDataFrame(HOME, "id string, book string"))


@query("WITH " + m.SENT_SQL + ", g AS (SELECT 'that' AS a, 'the' AS b, count(*) FILTER (contains(text, 'that')) AS hit, count(*) FILTER (contains(text, 'that') AND contains(text, 'the')) AS co FROM sent UNION ALL SELECT 'ich', 'und', count(*) FILTER (contains(text, 'ich')), count(*) FILTER (contains(text, 'ich') AND contains(text, 'und')) FROM sent) SELECT *, co >= 2 AND co >= 0.7 * hit AS good FROM g")
def cooccurrence_ratio(spark, d):
    """A22."""
    return audit.together_ratio(m.sentences(spark, d), [("that", "the"), ("ich", "und")])


@query("WITH h AS (SELECT unnest(regexp_extract_all(text, 'the ([a-z]+)', 1)) AS name FROM documents) SELECT name, count(*)::BIGINT AS n FROM h WHERE name NOT IN ('the', 'of') GROUP BY name HAVING count(*) >= 2")
def candidate_mining(spark, d):
    """A23."""
    return audit.mine(m.table(spark, d, "documents"), "the ([a-z]+)", spark.createDataFrame([("the",), ("of",)], "name string"))


@query("WITH u AS (SELECT unnest(regexp_extract_all(text, 'th([a-z]{2})', 1)) AS gram, 1 AS b, 0 AS f FROM documents UNION ALL SELECT unnest(regexp_extract_all(text, '([a-z]{2})ed', 1)), 0, 1 FROM documents), g AS (SELECT gram, sum(b)::BIGINT AS n_before, sum(f)::BIGINT AS n_after FROM u GROUP BY gram) SELECT *, CASE WHEN n_before + n_after < 3 THEN 'rare' WHEN n_before = 0 OR n_after = 0 THEN 'one side' END AS kill FROM g")
def bigram_slots(spark, d):
    """A24."""
    return audit.slots(m.table(spark, d, "documents"), "th", "ed")


@query("SELECT 'n1' AS rule, count(*) FILTER (length(c_name) <> 18)::BIGINT AS n FROM customer UNION ALL SELECT 'n2', count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL SELECT 'n3', count(*) FILTER (c_mktsegment NOT LIKE '%I%') FROM customer")
def name_audit(spark, d):
    """A25."""
    return audit.broken_rules(m.table(spark, d, "customer"), {"n1": F.length("c_name") != 18, "n2": F.col("c_acctbal") < 0, "n3": ~F.col("c_mktsegment").like("%I%")})


@query(m.M + " SELECT surface, book, count(*)::BIGINT AS n, count(DISTINCT chapter)::BIGINT AS n_chapters, count(DISTINCT id)::BIGINT AS n_ids, count(*) FILTER (nth > 1)::BIGINT AS n_later FROM ment GROUP BY 1, 2")
def review_stats(spark, d):
    """A18."""
    return audit.reviewed(m.mentions(spark, d))


@query("WITH r AS (SELECT o_orderstatus AS g, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS turn, count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders) SELECT g, o_orderkey FROM r ORDER BY turn, size DESC, g LIMIT 12")
def review_sample(spark, d):
    """A19."""
    return audit.round_robin(m.table(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), "o_orderkey"), "g", ["o_orderkey"], 12).select("g", "o_orderkey")


@query("WITH s AS (SELECT DISTINCT p_type AS alias, 'g' AS id FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_type AS alias, p_brand AS id FROM part WHERE p_size >= 10) SELECT alias, id FROM s UNION ALL SELECT alias, id FROM b WHERE alias NOT IN (SELECT alias FROM s)")
def dictionary_scope(spark, d):
    """J11, U1."""
    p = m.table(spark, d, "part")
    return audit.scoped_dictionary(p.filter("p_size < 10").select(F.col("p_type").alias("alias"), F.lit("g").alias("id")).distinct(), p.filter("p_size >= 10").select(F.col("p_type").alias("alias"), F.col("p_brand").alias("id")).distinct())


@query("WITH c AS (SELECT DISTINCT left(p_brand, 7) AS core FROM part) SELECT core, count(DISTINCT p_partkey)::BIGINT AS n FROM part JOIN c ON starts_with(p_brand, core) GROUP BY core HAVING count(DISTINCT p_partkey) >= 2")
def dictionary_compile(spark, d):
    """D9, J16."""
    p = m.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("title"))
    return audit.derived_titles(p, p.select(F.left("title", F.lit(7)).alias("core")).distinct()).select("core", F.size("candidates").cast("long").alias("n"))


@query("SELECT l_partkey % 3000 + 1 AS value, count(*)::BIGINT AS n FROM lineitem WHERE l_partkey % 3000 + 1 NOT IN (SELECT p_partkey FROM part WHERE p_size > 25) GROUP BY 1")
def dangling_references(spark, d):
    """D10, J7."""
    return audit.dangling(m.table(spark, d, "lineitem").select((F.col("l_partkey") % 3000 + 1).alias("k")), "k", m.table(spark, d, "part").filter("p_size > 25"), "p_partkey")


@query("WITH c AS (SELECT DISTINCT l_partkey AS rel_id, l_suppkey AS uid, 'accept' AS verdict FROM lineitem WHERE l_linenumber = 1), r AS (SELECT DISTINCT l_partkey AS rel_id, l_suppkey AS uid FROM lineitem) SELECT * FROM c UNION ALL SELECT rel_id, uid, 'accept' FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rel_id = r.rel_id AND c.uid = r.uid)")
def evidence_union(spark, d):
    """U6."""
    li = m.table(spark, d, "lineitem").select(F.col("l_partkey").alias("rel_id"), F.col("l_suppkey").alias("uid"), "l_linenumber")
    child = li.filter("l_linenumber = 1").select("rel_id", "uid").distinct().withColumn("verdict", F.lit("accept"))
    return audit.united_evidence(child, li.select("rel_id", "uid").distinct())


@query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def scope_union(spark, d):
    """U5."""
    return audit.united_scopes(m.table(spark, d, "events").select("user_id", F.array("event_type").alias("kinds")), "user_id", "kinds").select("user_id", F.concat_ws(",", "kinds").alias("kinds"))


@query("WITH p AS (SELECT * FROM " + m.values([("l01", "GREEN"), ("l02", "AU")], "id, alias") + ") SELECT c_custkey, id FROM customer JOIN p ON contains(c_mktsegment, alias)")
def title_places(spark, d):
    """J15."""
    places = spark.createDataFrame([("l01", ["GREEN"]), ("l02", ["AU"])], "id string, aliases array<string>")
    return audit.titles_with(places, m.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("title"))).select("c_custkey", "id")


