"""Reviews, audits and mining over mentions and texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a dictionary that is broadcast at most.
BROADCAST = 8 << 20


def alias_conflicts(entities: DataFrame) -> DataFrame:
    """Aliases with more than one owner."""
    return entities.select("id", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.sort_array(F.collect_set("id")).alias("owners")).filter(F.size("owners") > 1)


def scoped_dictionary(shared: DataFrame, scoped: DataFrame) -> DataFrame:
    """Alias, id: the shared ones, and of the scoped ones those that do not clash."""
    return shared.select("alias", "id").unionByName(scoped.select("alias", "id").join(shared.select("alias"), "alias", "left_anti"))


def guess_ratio(mentions: DataFrame) -> DataFrame:
    """Share of guessed mentions by surface."""
    return mentions.groupBy("surface").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == "guess").alias("n_guess")).withColumn("ratio", F.col("n_guess") / F.col("n"))


def ambiguity(mentions: DataFrame, home: DataFrame, least: int = 4, ratio: float = 0.35) -> DataFrame:
    """Surfaces often met outside their entity's home books (home: id, book)."""
    m = mentions.join(home.withColumn("native", F.lit(1)), ["id", "book"], "left").groupBy("surface", "id").agg(F.count("native").alias("n_native"), F.count_if(F.col("native").isNull()).alias("n_foreign"))
    return m.filter((F.col("n_foreign") >= least) & (F.col("n_foreign") >= ratio * (F.col("n_native") + F.col("n_foreign"))))


def together_ratio(sents: DataFrame, pairs: list[tuple[str, str]], share: float = 0.7, least: int = 2) -> DataFrame:
    """For each (a, b): sentences with a, of these with b, and whether that is often enough."""
    both = reduce(DataFrame.unionByName, [sents.agg(F.count_if(F.contains("text", F.lit(a))).alias("hit"), F.count_if(F.contains("text", F.lit(a)) & F.contains("text", F.lit(b))).alias("co")).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "hit", "co") for a, b in pairs])
    return both.withColumn("good", (F.col("co") >= least) & (F.col("co") >= share * F.col("hit")))


def mine(texts: DataFrame, pattern: str, known: DataFrame, least: int = 2) -> DataFrame:
    """What the pattern's first group finds, counted, without what is known (name)."""
    hit = texts.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("name"))
    return hit.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).join(known.select("name"), "name", "left_anti")


def slots(texts: DataFrame, before: str, after: str, least: int = 3) -> DataFrame:
    """Pairs of letters by how often they stand behind `before` or ahead of `after`."""
    a = texts.select(F.explode(F.regexp_extract_all("text", F.lit(before + "([a-z]{2})"), F.lit(1))).alias("gram"), F.lit(1).alias("b"), F.lit(0).alias("f"))
    z = texts.select(F.explode(F.regexp_extract_all("text", F.lit("([a-z]{2})" + after), F.lit(1))).alias("gram"), F.lit(0).alias("b"), F.lit(1).alias("f"))
    g = a.unionByName(z).groupBy("gram").agg(F.sum("b").alias("n_before"), F.sum("f").alias("n_after"))
    return g.withColumn("kill", F.when(F.col("n_before") + F.col("n_after") < least, "rare").when(F.col("n_before") == 0, "one side").when(F.col("n_after") == 0, "one side"))


def broken_rules(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule: all rules in one scan, then turned to rows."""
    counts = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()])
    return counts.select(F.expr(f"stack({len(rules)}, " + ", ".join(f"'{k}', {k}" for k in rules) + ") as (rule, n)"))


def reviewed(mentions: DataFrame) -> DataFrame:
    """For each surface and book: all, chapters, entities, guesses."""
    return mentions.groupBy("surface", "book").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chapter").alias("n_chapters"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("nth") > 1).alias("n_later"))


def round_robin(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """K rows, one of each group in turn, larger groups first."""
    w = Window.partitionBy(by)
    r = rows.withColumn("turn", F.row_number().over(w.orderBy(*order))).filter(F.col("turn") <= k)
    size = rows.groupBy(by).agg(F.count(F.lit(1)).alias("size"))
    return r.join(size, by).orderBy("turn", F.desc("size"), by).limit(k)


def not_fixed(strings: DataFrame, f) -> DataFrame:
    """Strings (column s) that f changes, or that it changes again the second time."""
    return strings.withColumn("once", f(F.col("s"))).withColumn("twice", f(F.col("once"))).filter("once <> s or twice <> once")


def derived_titles(persons: DataFrame, cores: DataFrame) -> DataFrame:
    """Titles of a family with two candidates or more: persons (id, title), cores (core). A title meets its
    prefixes of the lengths that cores have, by equality."""
    hit = persons.select("id", F.explode(_parts_of(F.col("title"), _lengths(cores, "core"), F.lit(1))).alias("core")).join(cores.distinct(), "core")
    return hit.groupBy("core").agg(F.sort_array(F.collect_set("id")).alias("candidates")).filter(F.size("candidates") >= 2)


def dangling(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Values that refer to nothing, with how often."""
    return rows.select(F.col(column).alias("value")).filter("value is not null").join(keys.select(F.col(key).alias("value")), "value", "left_anti").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def united_evidence(child: DataFrame, main: DataFrame) -> DataFrame:
    """The child table's evidence (rel_id, uid, verdict), and the main row's where the child has none of it."""
    rest = main.filter("uid is not null").select("rel_id", "uid").join(child.select("rel_id", "uid"), ["rel_id", "uid"], "left_anti").withColumn("verdict", F.lit("accept"))
    return child.select("rel_id", "uid", "verdict").unionByName(rest)


def united_scopes(rows: DataFrame, by: str, lists: str) -> DataFrame:
    """The distinct members of all lists of a key; sets are united on each side of the shuffle, so a hot key costs no
    more than its members. A key whose lists are all empty or null has none."""
    return rows.select(by, F.explode_outer(lists).alias(lists)).groupBy(by).agg(F.sort_array(F.collect_set(lists)).alias(lists))


def titles_with(places: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters whose title holds a place's alias: a title's substrings of the lengths that aliases have meet them by
    equality, each once. The substrings are many times what the planner takes the titles for, so they are never the side
    that is broadcast: the aliases are, if they are measured to be few, else both sides are sorted and merged."""
    rows = places.select("id", F.explode("aliases").alias("alias")).filter("alias <> ''").distinct()
    found = rows.groupBy(F.length("alias").alias("n")).agg(F.sum(F.octet_length("alias") + F.coalesce(F.octet_length(F.col("id").cast("string")), F.lit(0)) + 64).alias("size")).collect()
    parts = _parts_of(F.col("title"), sorted(r["n"] for r in found), None)
    few = sum(r["size"] for r in found) <= BROADCAST
    return chapters.withColumn("alias", F.explode(parts)).join(rows.hint("broadcast" if few else "merge"), "alias")


def _lengths(rows: DataFrame, column: str) -> list[int]:
    """The lengths that a dictionary's words have, a few numbers however long it is."""
    return sorted(r[0] for r in rows.select(F.length(column)).distinct().collect() if r[0])


def _parts_of(text: Column, lengths: list[int], at: Column | None) -> Column:
    """The distinct substrings of these lengths, at one place or (None) at every place."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        last = F.length(text) - (n - 1)
        places = F.array(at) if at is not None else F.sequence(F.lit(1), last)
        return F.when(last >= 1, F.transform(places, lambda i: F.substring(text, i, F.lit(n)))).otherwise(none)

    return F.array_distinct(F.concat(none, *[of(n) for n in lengths]))
