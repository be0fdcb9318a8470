"""Counts, indexes, search and windows over the corpus adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkspan.operators import index

from . import model as m
from .registry import query

BUCKETS = [("n_low", 0, 299), ("n_mid", 300, 599), ("n_high", 600, 10**9)]
BOOKS_SQL = "books AS (SELECT DISTINCT source AS book FROM documents)"
COUNTS = "cnt AS (SELECT id, book, count(*)::BIGINT AS n, count(DISTINCT chapter)::BIGINT AS c FROM ment GROUP BY id, book)"


def counts(spark: SparkSession, d: str, entities=m.PERSONS) -> DataFrame:
    return index.counts_by_book(m.mentions(spark, d, entities))


@query("SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'type:' || event_type, count(*) FROM events GROUP BY event_type")
def stats_tables(spark, d):
    one = lambda t: m.table(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
    out = one("documents")
    for t in ("events", "lineitem", "pages"):
        out = out.unionByName(one(t))
    return out.unionByName(m.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("type:"), "event_type").alias("name"), "n"))


@query("WITH " + m.SENT_SQL + " SELECT uid, chapter, para_seq::BIGINT AS para_seq, seq::BIGINT AS seq, length(text)::BIGINT AS n_chars, md5(text) AS digest FROM sent")
def sentence_split(spark, d):
    return m.sentences(spark, d).select("uid", "chapter", F.col("para_seq").cast("long").alias("para_seq"), F.col("seq").cast("long").alias("seq"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("digest"))


@query("WITH " + m.SENT_SQL + " SELECT chapter, count(DISTINCT para_seq)::BIGINT AS n_paragraphs, count(*)::BIGINT AS n_sentences, sum(length(text))::BIGINT AS n_chars FROM sent GROUP BY chapter")
def paragraph_counts(spark, d):
    return m.sentences(spark, d).groupBy("chapter").agg(F.count_distinct("para_seq").alias("n_paragraphs"), F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("text")).cast("long").alias("n_chars"))


@query(m.M + ", " + COUNTS + " SELECT * FROM cnt")
def mention_counts_by_book(spark, d):
    return counts(spark, d)


@query(m.M + ", " + COUNTS + f" SELECT p.id, p.name, sum(n)::BIGINT AS n, sum(c)::BIGINT AS c, string_agg(book, ',' ORDER BY n DESC, book) AS books FROM cnt JOIN {m.PERSON_SQL} p USING (id) GROUP BY p.id, p.name")
def person_index(spark, d):
    return index.entity_index(counts(spark, d), m.persons(spark).select("id", "name")).select("id", "name", "n", "c", "books")


@query(m.MP + f", cnt AS (SELECT id, book, count(*)::BIGINT AS n, count(DISTINCT chapter)::BIGINT AS c FROM pment GROUP BY id, book) SELECT p.kind, p.id, sum(n)::BIGINT AS n, sum(c)::BIGINT AS c FROM cnt JOIN {m.PLACE_SQL} p USING (id) GROUP BY p.kind, p.id")
def place_index(spark, d):
    return index.rolled_up(counts(spark, d, m.PLACES)).join(m.places(spark).select("id", "kind"), "id").select("kind", "id", "n", "c")


@query(m.M + " SELECT surface AS w, count(*)::BIGINT AS n, count(DISTINCT chapter)::BIGINT AS c FROM ment GROUP BY surface ORDER BY c DESC, n DESC, w LIMIT 8")
def quick_words(spark, d):
    per = m.mentions(spark, d).groupBy("surface", "chapter").agg(F.count(F.lit(1)).alias("k")).groupBy(F.col("surface").alias("w")).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("c"))
    return per.orderBy(F.desc("c"), F.desc("n"), "w").limit(8).select("w", "n", "c")


@query(m.M + ", " + COUNTS + ", " + BOOKS_SQL + f" SELECT p.id, b.book, coalesce(c.n, 0)::BIGINT AS n FROM {m.PERSON_SQL} p CROSS JOIN books b LEFT JOIN cnt c ON c.id = p.id AND c.book IS NOT DISTINCT FROM b.book")
def mention_by_book_zero_filled(spark, d):
    books = m.table(spark, d, "documents").select(F.col("source").alias("book")).distinct()
    return index.zero_filled(counts(spark, d), books, m.persons(spark)).select("id", "book", "n")


@query(m.M + ", " + COUNTS + " SELECT id, book, n, c FROM cnt WHERE book IN ('src0', 'src2')")
def index_narrowed(spark, d):
    return index.narrowed(counts(spark, d), ["src0", "src2"]).select("id", "book", "n", "c")


@query(m.M + ", " + COUNTS + f", hit AS (SELECT p.id FROM {m.values([(p[0], p[1], p[4]) for p in m.PERSONS], 'id, name, aliases')} p WHERE p.name ILIKE '%TH%' OR len(list_filter(p.aliases, lambda a: a ILIKE '%TH%')) > 0), r AS (SELECT c.*, row_number() OVER (PARTITION BY id ORDER BY n DESC, book) AS rank FROM cnt c WHERE id IN (SELECT id FROM hit)) SELECT id, book, n, rank::INT AS rank FROM r WHERE rank <= 3")
def search_top_books(spark, d):
    hit = index.search(m.persons(spark), "TH").select("id")
    return index.top_per_group(counts(spark, d).join(hit, "id", "left_semi"), ["id"], [F.desc("n"), F.asc("book")], 3).select("id", "book", "n", "rank")


@query(m.MP + ", a AS (SELECT DISTINCT uid, id FROM ment), b AS (SELECT DISTINCT uid, id FROM pment), g AS (SELECT a.id AS a, b.id AS b, count(*)::BIGINT AS n FROM a JOIN b USING (uid) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rank FROM g) SELECT a, b, n, rank::INT AS rank FROM r WHERE rank <= 3")
def cooccur_top_persons(spark, d):
    sents = m.sentences(spark, d)
    g = index.cooccurrence(m.find_mentions(sents, m.surfaces(m.PERSONS)), m.find_mentions(sents, m.surfaces(m.PLACES)))
    return index.top_per_group(g, ["b"], [F.desc("n"), F.asc("a")], 3).select("a", "b", "n", "rank")


@query(m.M + ", p AS (SELECT uid FROM ment GROUP BY uid HAVING bool_or(id = 'p01') AND bool_or(id = 'p03')) SELECT uid, count(DISTINCT CASE WHEN id NOT IN ('p01', 'p03') THEN id END)::BIGINT AS others FROM ment WHERE uid IN (SELECT uid FROM p) GROUP BY uid")
def pair_sentences_others(spark, d):
    return index.pair_sentences(m.mentions(spark, d), "p01", "p03")


@query(m.M + f" SELECT id, count(*)::BIGINT AS n FROM ment WHERE book IN (SELECT book FROM {m.values(m.ERAS, 'book, era_from, era_to')} WHERE era_from <= 2 AND era_to >= 2) GROUP BY id")
def era_semi_join(spark, d):
    return index.in_era(m.mentions(spark, d), m.book_eras(spark), 2).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_anti_join(spark, d):
    orders = m.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return m.table(spark, d, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%GR%' ORDER BY p_partkey LIMIT 50")
def like_search(spark, d):
    return m.table(spark, d, "part").filter(F.col("p_name").ilike("%GR%")).select("p_partkey", "p_name").orderBy("p_partkey").limit(50)


@query("SELECT 'p02' AS id")
def alias_search(spark, d):
    return index.resolve_name(m.persons(spark), "whou")


@query("WITH " + m.SENT_SQL + r" SELECT uid FROM sent WHERE contains(lower(regexp_replace(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', '', 'g')), 'ofthe')")
def fts_phrase(spark, d):
    return index.phrase(m.sentences(spark, d), "Of the").select("uid")


@query(m.M + " SELECT uid, nth::INT AS nth, surface, id, row_number() OVER (PARTITION BY uid, surface ORDER BY nth)::INT AS of_surface FROM ment")
def mention_nth(spark, d):
    return index.nth_mentions(m.mentions(spark, d)).select("uid", "nth", "surface", "id", "of_surface")


@query(m.M + " SELECT id, " + ", ".join(f"nullif(count(*) FILTER (chapter BETWEEN {a} AND {b}), 0)::BIGINT AS {n}" for n, a, b in BUCKETS) + ", count(*)::BIGINT AS n_all FROM ment GROUP BY id")
def volume_bucket_pivot(spark, d):
    return index.bucket_pivot(m.mentions(spark, d), BUCKETS)


@query(m.M + ", f AS (SELECT id, substr(surface, 1, 2) AS key, surface, count(*)::BIGINT AS n FROM ment GROUP BY 1, 2, 3), g AS (SELECT id, key, (list(surface ORDER BY n DESC, surface))[1] AS w, sum(n)::BIGINT AS n, string_agg(surface, ',' ORDER BY surface) AS variants FROM f GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, w)::INT AS seq FROM g")
def alias_grouping(spark, d):
    return index.grouped_aliases(m.mentions(spark, d), F.substring("surface", 1, 2)).select("id", "key", "w", "n", "variants", "seq")


@query(m.MP + f", dec AS (SELECT id, unnest(aliases) AS w, generate_subscripts(aliases, 1) AS pos FROM {m.values([(p[0], p[3]) for p in m.PLACES], 'id, aliases')}), seen AS (SELECT id, surface AS w, count(*)::BIGINT AS n FROM pment GROUP BY 1, 2) SELECT id, w, coalesce(n, 0)::BIGINT AS n, row_number() OVER (PARTITION BY id ORDER BY pos NULLS LAST, n DESC, w)::INT AS seq FROM dec FULL JOIN seen USING (id, w)")
def place_alias_counts(spark, d):
    return index.declared_and_observed(m.mentions(spark, d, m.PLACES), m.places(spark))


@query(m.M + " SELECT surface, id, CASE WHEN nth = 1 THEN 'core' ELSE 'related' END AS tier, count(*)::BIGINT AS n FROM ment GROUP BY 1, 2, 3")
def generic_breakdown(spark, d):
    return m.mentions(spark, d).groupBy("surface", "id", F.when(F.col("nth") == 1, "core").otherwise("related").alias("tier")).agg(F.count(F.lit(1)).alias("n"))


NOTES = m.surfaces(m.PERSONS)


@query(
    f"WITH n0 AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, {m.q(m.alternation(list(NOTES)))})) AS surface, generate_subscripts(regexp_extract_all(text, {m.q(m.alternation(list(NOTES)))}), 1) AS k FROM conversations), n AS (SELECT n0.*, o.id FROM n0 JOIN {m.values(sorted(NOTES.items()), 'alias, id')} o ON o.alias = surface), "
    "a AS (SELECT *, row_number() OVER (PARTITION BY id, conv_id ORDER BY turn, k) AS in_conv FROM n), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY conv_id, turn, k) AS r FROM a WHERE in_conv <= 8) SELECT id, conv_id, turn, k::INT AS k, surface FROM b WHERE r <= 40"
)
def note_samples(spark, d):
    """At most 8 samples for each conversation and 40 for each entity, in order of place."""
    own = F.create_map(*[F.lit(v) for kv in sorted(NOTES.items()) for v in kv])
    n = m.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(m.alternation(list(NOTES))), F.lit(0))).alias("k", "surface"))
    n = n.withColumn("k", F.col("k") + 1).withColumn("id", F.element_at(own, F.col("surface")))
    a = index.top_per_group(n, ["id", "conv_id"], ["turn", "k"], 8).drop("rank")
    return index.top_per_group(a, ["id"], ["conv_id", "turn", "k"], 40).select("id", "conv_id", "turn", "k", "surface")


@query(m.MP + ", g AS (SELECT chapter, id, count(*)::BIGINT AS n FROM pment GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY n DESC, id) AS rank FROM g) SELECT chapter, id, n, rank::INT AS rank, rank <= 3 AND n >= 8 AS dense FROM r WHERE rank <= 6")
def chapter_top_places(spark, d):
    g = m.mentions(spark, d, m.PLACES).groupBy("chapter", "id").agg(F.count(F.lit(1)).alias("n"))
    return index.top_per_group(g, ["chapter"], [F.desc("n"), F.asc("id")], 6).select("chapter", "id", "n", "rank", ((F.col("rank") <= 3) & (F.col("n") >= 8)).alias("dense"))


@query("WITH f AS (SELECT c_mktsegment, c_acctbal < 0 AS debtor, c_name LIKE '%1' AS first, c_acctbal > 5000 AS rich FROM customer) SELECT c_mktsegment, count(*)::BIGINT AS n, count(*) FILTER (debtor)::BIGINT AS n_debtor, count(*) FILTER (first)::BIGINT AS n_first, count(*) FILTER (rich)::BIGINT AS n_rich, count(*) FILTER (NOT debtor AND NOT first AND NOT rich)::BIGINT AS n_default FROM f GROUP BY c_mktsegment")
def category_facets(spark, d):
    """Flags that do not exclude each other, and a default bucket."""
    f = m.table(spark, d, "customer").select("c_mktsegment", (F.col("c_acctbal") < 0).alias("debtor"), F.col("c_name").endswith("1").alias("first"), (F.col("c_acctbal") > 5000).alias("rich"))
    return f.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{c}") for c in ("debtor", "first", "rich")], F.count_if(~F.col("debtor") & ~F.col("first") & ~F.col("rich")).alias("n_default"))


@query(m.M + " SELECT chapter, min(r)::BIGINT AS start, (max(r) + 1)::BIGINT AS \"end\" FROM (SELECT chapter, row_number() OVER (ORDER BY chapter, para_seq, seq) - 1 AS r FROM sent) GROUP BY chapter")
def chapter_ranges(spark, d):
    return index.chapter_ranges(m.sentences(spark, d))


@query(m.M + ", g AS (SELECT chapter, id, count(*)::BIGINT AS n FROM ment GROUP BY 1, 2), x AS (SELECT chapter, max(n) AS n FROM g GROUP BY 1) SELECT chapter, min(id) AS id, n FROM g JOIN x USING (chapter, n) WHERE n >= 2 GROUP BY chapter, n HAVING count(*) = 1")
def dominant_person(spark, d):
    g = m.mentions(spark, d).groupBy("chapter", "id").agg(F.count(F.lit(1)).alias("n"))
    return index.dominant(g, ["chapter"], 2)


@query("WITH " + m.SENT_SQL + ", x AS (SELECT *, sum((length(text) - length(replace(text, '(', ''))) - (length(text) - length(replace(text, ')', '')))) OVER (PARTITION BY chapter, para_seq ORDER BY seq) AS run FROM sent) SELECT uid, (run - least(0, min(run) OVER (PARTITION BY chapter, para_seq ORDER BY seq)))::BIGINT AS depth FROM x")
def quote_depth(spark, d):
    return index.quote_depth(m.sentences(spark, d), "(", ")").select("uid", F.col("depth").cast("long").alias("depth"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS before, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS after FROM lineitem) SELECT l_orderkey, l_linenumber, before, after FROM l")
def lineage_neighbours(spark, d):
    """W9."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    return m.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lag("l_partkey").over(w).alias("before"), F.lead("l_partkey").over(w).alias("after"))


@query("WITH g AS (SELECT user_id, event_type, count(*)::BIGINT AS n, min(ts) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, event_type) AS k FROM g) SELECT user_id, event_type, n FROM r WHERE k = 1")
def most_common_kind(spark, d):
    """Mode, ties by the first met."""
    g = m.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"))
    return index.top_per_group(g, ["user_id"], [F.desc("n"), F.asc("first"), F.asc("event_type")], 1).select("user_id", "event_type", "n")


@query("WITH l AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) FILTER (ts < p)::BIGINT AS n_back FROM l GROUP BY user_id")
def monotone_check(spark, d):
    """W12."""
    e = m.table(spark, d, "events").withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.groupBy("user_id").agg(F.count_if(F.col("ts") < F.col("p")).alias("n_back"))


@query()
def interval_greedy(spark, d):
    """W13 over the spans of each sentence's mentions, widened by two so that some overlap."""
    from inkspan.operators.annotate import spans_in

    s = m.sentences(spark, d).select("uid", spans_in(F.col("text"), m.surfaces(m.PERSONS)).alias("spans"))
    wide = F.transform("spans", lambda x: F.struct(F.greatest(x["s"] - 2, F.lit(0)).alias("s"), (x["e"] + 2).alias("e")))
    return s.select("uid", F.size("spans").alias("n_spans"), F.size(index.greedy_intervals(wide)).alias("n_kept"))
