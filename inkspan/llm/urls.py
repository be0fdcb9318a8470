"""URL filters: rules first, then gradient-boosted trees on lexical features.

Rules name a host and a path prefix; one fits its host and all subdomains if the URL's path starts with the rule's,
and the longest fitting rule wins. URLs that no rule fits are judged by trees trained on labelled URLs: those that a
rule decides, or any table of url and label (1: block). The training sample is the TRAIN distinct labelled URLs with the
least hash, so it is bounded, repeatable and spread over all of them, and a URL counts once however often it is seen. The
suffix statistics used as a feature are counts of all labelled rows, made in one aggregation and joined by suffix.
The fitted trees become a CASE expression, so that judging stays in the JVM.

Features: lengths of URL, host and path; path depth; host labels; digit and non-letter shares; entropy of the URL's
characters; number of parameters; a fragment; scheme; share of blocked URLs, smoothed, for the host's last label and
last two, the path's first folder, and the last segment's extension.

Null URL or one without `://`: host and path are empty, no rule fits, and the trees judge it like any other. Repeated
rows are judged alike. Other columns do not matter. Empty table: empty result. Without labelled rows of both kinds
the trees' base rate decides (allow, if there are none at all).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import cut, small
from .quality import let

#: verdict, host, path prefix.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs that the trees see at most.
TRAIN = 20_000
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), AZ, az), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1), F.lit(""))
    return host, path


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Length is that of host and path together."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def entropy(text: Column) -> Column:
    """Bits a character, over all of the text's characters: they are sorted, and each run of one adds its count once."""

    def bits(s: Column) -> Column:
        n = F.size(s)

        def step(acc: Column, i: Column) -> Column:
            ends = (i == n) | F.coalesce(F.get(s, i - 1) != F.get(s, i), F.lit(True))
            run = acc["run"] + 1
            return F.struct(F.when(ends, F.lit(0)).otherwise(run).alias("run"), (acc["sum"] + F.when(ends, run * F.log2(run.cast("double"))).otherwise(0.0)).alias("sum"))

        whole = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0).alias("run"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])
        return F.when(n > 0, F.round(F.log2(n.cast("double")) - whole / n, 6)).otherwise(0.0)

    return let(F.array_sort(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), bits)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    low = F.translate(url, AZ, az)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    count = lambda x, c: F.length(x) - F.length(F.translate(x, c, ""))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return {
        "length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": count(path, "/"),
        "labels": count(host, "."),
        "digits": count(url, "0123456789") / n,
        "odd": F.length(F.translate(low, az + "0123456789", "")) / n,
        "entropy": entropy(low),
        "params": F.when(query == "", F.lit(0)).otherwise(count(query, "&") + 1),
        "fragment": F.when(F.instr(url, "#") > 0, 1).otherwise(0),
        "secure": F.when(F.startswith(low, F.lit("https:")), 1).otherwise(0),
        "hyphens": count(host, "-"),
    }


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """The host's last label and last two, the path's first folder, and the extension of its last segment."""
    return {
        "top": F.regexp_extract(host, r"([^.]*)$", 1), "domain": F.regexp_extract(host, r"([^.]*\.?[^.]*)$", 1),
        "folder": F.regexp_extract(path, r"^/([^/]*)/", 1), "extension": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    }


def parsed(urls: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, found (rule and verdict), features and suffixes to rows with a url."""
    host, path = host_and_path(F.col("url"))
    rows = urls.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    u = F.coalesce("url", F.lit(""))
    return rows.withColumns({f"f_{k}": c.cast("double") for k, c in lexical(u, F.col("host"), F.col("path")).items()} | {f"s_{k}": c for k, c in suffixes(F.col("host"), F.col("path")).items()})


def suffix_rates(labelled: DataFrame) -> tuple[dict[str, DataFrame], float]:
    """labelled: a parsed() table with label. For each kind of suffix, its values with their smoothed share of blocked
    rows, in the kind's column and r_ and the kind; and the share over all rows. Nothing is sampled or capped."""
    kinds = [c for c in labelled.columns if c.startswith("s_")]
    y, n = labelled.agg(F.coalesce(F.sum("label"), F.lit(0.0)), F.count("label")).first()
    prior = (y + 1) / (n + 2) if n else 0.0
    share = (F.sum("label") + 5 * prior) / (F.count("label") + 5)
    return {c: labelled.groupBy(c).agg(share.alias(f"r_{c}")) for c in kinds}, float(prior)


def with_rates(rows: DataFrame, rates: dict[str, DataFrame], prior: float) -> DataFrame:
    """rows with the rate of each kind of suffix; the prior where none is known."""
    for c, table in rates.items():
        rows = rows.join(table, c, "left").withColumn(f"r_{c}", F.coalesce(f"r_{c}", F.lit(prior)))
    return rows


def distinct_sample(labelled: DataFrame, limit: int) -> DataFrame:
    """url, label: the `limit` distinct URLs with the least hash; of differing labels, the mean. As in least_hashes, only
    about as many as are wanted are grouped and ordered."""
    rows, h = labelled.select("url", "label"), F.xxhash64("url")
    n = rows.agg(F.approx_count_distinct("url")).first()[0]
    if n > 2 * limit:
        span = 1 << 63
        rows = rows.filter(h < F.lit(int(-span + 2 * span * 1.5 * limit / n)))
    return rows.groupBy("url").agg(F.avg("label").alias("label")).orderBy(h, "url").limit(limit)


def train(labelled: DataFrame, limit: int = TRAIN) -> tuple[boosting.Model, dict[str, DataFrame], float]:
    """labelled: a parsed() table with label (1.0: block). Returns the trees, the suffixes' rates and the prior."""
    names = [c for c in labelled.columns if c.startswith("f_")]
    rates, prior = suffix_rates(labelled)
    rates = {c: small(cut(t, "rates")) for c, t in rates.items()}
    picked = with_rates(parsed(distinct_sample(labelled, limit)), rates, prior)
    kinds = [f"r_{c}" for c in rates]
    rows = picked.select("url", "label", *names, *kinds).orderBy(F.xxhash64("url"), "url").collect()
    y = np.array([r["label"] for r in rows], float)
    x = np.array([[r[c] for c in names + kinds] for r in rows], float).reshape(len(rows), len(names + kinds))
    return boosting.fit(x, y, names + kinds, rounds=20, depth=3), rates, prior


def judge(pages: DataFrame, rules=RULES, limit: int = TRAIN) -> DataFrame:
    """page_id, url, host, path, rule, verdict, by (rule or model)."""
    rows = parsed(pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")), rules)
    own = rows.filter(F.col("found").isNotNull()).withColumn("label", (F.col("found.verdict") == "block").cast("double"))
    model, rates, prior = train(own, limit)
    rows = with_rates(rows, rates, prior).withColumn("model_block", model.column(F.col) > 0)
    return rows.select(
        "page_id", "url", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", F.when(F.col("model_block"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("found").isNull(), "model").otherwise("rule").alias("by"),
    )


def report(pages: DataFrame) -> DataFrame:
    return judge(pages).select("page_id", "host", "path", "rule", "verdict", "by")
