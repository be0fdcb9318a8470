"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Base rules: fewer than 50 words, or more than half of the words in three-word windows that occur twice or more.
Beyond them, a document that passes is judged by a vector of transformed statistics (log of the mean word length; the
shares of symbols per word character, of repeated lines, and of words in repeated windows) against a minimum-
covariance-determinant estimate for its language and source. Three deterministic starts are made from medians and MADs: their
diagonal, the correlations of the hyperbolic tangents of standardised values, and those of their directions. From each,
concentration steps keep the three quarters of a group nearest to the last centre and take their mean and covariance, until
the determinant falls no more; the start with the least determinant holds. The squared Mahalanobis distance must not pass
CUTOFF. Each variable has a tolerance whose square is added to its variance (a regularised determinant), so a group in
which a statistic is always zero does not reject the first document that has a little of it.

Medians and shares are read from counts on a fixed grid, so they do not depend on how rows are laid out. Groups of fewer than SMALL
documents are put together by language. Sums and counts are partial before each shuffle, so a hot source costs a row a task.
Statistics of a document are computed once, into a narrow table; the steps then read only that.

Null text: no words, so it fails. Null lang or source: groups of their own. Equal rows get equal verdicts. Empty
table: empty result. Other columns do not matter.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, cut, small

SYMBOLS = "#*$%&|<>"
#: Variables and their tolerances.
TOLERANCE = {"x_length": 0.12, "x_symbols": 0.012, "x_lines": 0.1, "x_repeats": 0.1}
CUTOFF = 23.51  # 0.9999 quantile of chi-square, 4 degrees of freedom
KEPT = 0.75  # of a group, by a concentration step
CONSISTENT = 1.486  # 0.75 over the share of chi-square(6) under the 0.75 quantile of chi-square(4)
#: A step whose determinant is not less by this share is the last; STEPS at most, as counts on a grid may make the end waver.
LESS, STEPS = 1e-3, 30
SMALL = 50
#: Slots of the grids: for a unit of a statistic, and of log(1 + squared distance).
FINE, FAR = 10_000, 1_000
#: Bits of a sort key that hold a window's place; the rest hold hash bits, and what they find is looked at again.
PLACE_BITS = 26


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.transform(F.array(value), body)[0]


def _n_repeat(words: Column) -> Column:
    """Words in three-word windows that the array has twice or more."""
    n = F.size(words)
    low = (1 << PLACE_BITS) - 1
    # 1. sort the windows' hash bits with their places in the low bits; neighbours with the same high bits may be repeats
    keys = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
    same = lambda a, b: F.shiftright(a, PLACE_BITS) == F.shiftright(b, PLACE_BITS)
    likely = lambda s: F.filter(s, lambda x, i: F.coalesce(same(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(s, i + 1)), F.lit(False)))
    # 2. among those few, compare the words themselves
    exact = lambda s: F.array_sort(F.transform(s, lambda x: let(x.bitwiseAND(F.lit(low)).cast("int"), lambda i: F.struct(words[i].alias("a"), words[i + 1].alias("b"), words[i + 2].alias("c"), i.alias("i")))))
    equal = lambda x, y: F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"]), F.lit(False))
    sure = lambda t: F.array_sort(F.transform(F.filter(t, lambda x, i: equal(x, F.get(t, i - 1)) | equal(x, F.get(t, i + 1))), lambda x: x["i"]))
    # 3. each window covers up to the next one's start, three words at most
    covered = lambda p: F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3))), F.lit(0), lambda a, x: a + x)
    found = let(F.sort_array(keys), lambda s: let(likely(s), lambda c: F.when(F.size(c) == 0, F.lit(0)).otherwise(let(exact(c), lambda t: let(sure(t), covered)))))
    return F.when(n < 3, F.lit(0)).otherwise(found).cast("long")


def statistics(text: Column) -> dict[str, Column]:
    """Columns of what the rules look at."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    bare = lambda x: F.translate(x, " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: bare(x) != "")
    words = F.regexp_extract_all(text, F.lit(SPACE_WORDS), F.lit(0))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _n_repeat(w).alias("n_repeat_words")))
    return {
        "counted": counted,
        "word_chars": F.length(bare(text)).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "by_line": let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    }


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_key, the counts, base_failed and the transformed vector."""
    s = statistics(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), *[c.alias(k) for k, c in s.items()]
    )
    rows = rows.select("doc_id", "lang", "source", "text_key", "counted.*", "word_chars", "n_symbols", "by_line.*")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x_length": F.log(F.greatest(share("word_chars", "n_words"), F.lit(0.1))),
            "x_symbols": share("n_symbols", "word_chars"),
            "x_lines": share("n_dup_lines", "n_lines"),
            "x_repeats": share("n_repeat_words", "n_words"),
        }
    )


def _distance(names: list[str]) -> Column:
    """Squared Mahalanobis distance from the row's vector and its group's centre (m_*) and Cholesky factor (l_*)."""
    y: list[Column] = []
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * y[j]
        y.append(rest / F.col(f"l_{i}_{i}"))
    total = y[0] * y[0]
    for v in y[1:]:
        total = total + v * v
    return total


def _factor(rows: DataFrame, names: list[str]) -> DataFrame:
    """Adds the Cholesky factor (l_i_j) of the covariance (c_i_j) to each group's row, column by column, and its determinant."""
    p = len(names)
    for j in range(p):
        done = [F.col(f"l_{j}_{k}") for k in range(j)]
        rows = rows.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(F.col(f"c_{j}_{j}") - sum((x * x for x in done), F.lit(0.0)), F.lit(1e-12))))
        rows = rows.withColumns({f"l_{i}_{j}": (F.col(f"c_{j}_{i}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}") for i in range(j + 1, p)})
    det = F.lit(1.0)
    for j in range(p):
        det = det * F.col(f"l_{j}_{j}") * F.col(f"l_{j}_{j}")
    return rows.withColumn("det", det)


def quantile(rows: DataFrame, by: list[str], value: Column, share: float, slots: int) -> DataFrame:
    """by, slot: the slot of value (slots of them to a unit) at which `share` of a group's rows is reached."""
    counts = rows.groupBy(*by, F.floor(value * slots).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("slot"))).withColumn("all", F.sum("n").over(w))
    return counts.filter(F.col("upto") >= F.col("all") * share).groupBy(*by).agg(F.min("slot").alias("slot"))


def _medians(rows: DataFrame, values: dict[str, Column], prefix: str) -> DataFrame:
    """grp and the median of each value, in columns named prefix and the value's name."""
    long = rows.select("grp", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), v.alias("value")) for x, v in values.items()])).alias("x")).select("grp", "x.*")
    found = quantile(long, ["grp", "name"], F.col("value"), 0.5, FINE)
    return found.groupBy("grp").agg(*[F.max(F.when(F.col("name") == x, (F.col("slot") + 0.5) / FINE)).alias(f"{prefix}_{x}") for x in values])


def starts(rows: DataFrame) -> DataFrame:
    """grp, start, centre and factor: three rows for each group."""
    names = list(TOLERANCE)
    p = len(names)
    centre = cut(_medians(rows, {x: F.col(x) for x in names}, "m"), "centres")
    spread = _medians(rows.join(small(centre), "grp"), {x: F.abs(F.col(x) - F.col(f"m_{x}")) for x in names}, "s")
    base = cut(centre.join(spread, "grp").withColumns({f"s_{x}": F.sqrt(F.pow(F.col(f"s_{x}") * 1.4826, 2) + TOLERANCE[x] ** 2) for x in names}), "spreads")
    z = {x: (F.col(x) - F.col(f"m_{x}")) / F.col(f"s_{x}") for x in names}
    norm = F.sqrt(sum((v * v for v in z.values()), F.lit(1e-12)))
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]
    at = rows.join(small(base.select("grp", *[f"{k}_{x}" for k in "ms" for x in names])), "grp")
    at = at.groupBy("grp").agg(
        *[F.covar_pop(F.tanh(z[names[i]]), F.tanh(z[names[j]])).alias(f"t_{i}_{j}") for i in range(p) for j in range(i, p)],
        *[F.avg(z[names[i]] * z[names[j]] / (norm * norm)).alias(f"u_{i}_{j}") for i in range(p) for j in range(i, p)],
    )
    # correlations, made a little weaker so that a factor exists
    tame = lambda k, i, j: 0.95 * F.col(f"{k}_{i}_{j}") / F.sqrt(F.greatest(F.col(f"{k}_{i}_{i}") * F.col(f"{k}_{j}_{j}"), F.lit(1e-12)))
    kinds = [{k: F.lit(0.0) for k in pairs}, *[{(i, j): tame(k, i, j) for i, j in pairs} for k in "tu"]]
    wide = base.join(at, "grp").withColumn("start", F.explode(F.array(*map(F.lit, range(len(kinds))))))
    scale = [F.col(f"s_{x}") for x in names]
    cells = {f"c_{i}_{i}": scale[i] * scale[i] for i in range(p)}
    for i, j in pairs:
        r = kinds[0][i, j]
        for k in range(1, len(kinds)):
            r = F.when(F.col("start") == k, kinds[k][i, j]).otherwise(r)
        cells[f"c_{i}_{j}"] = r * scale[i] * scale[j]
    return _factor(wide.withColumns(cells), names).select(*_columns(names))


def _columns(names: list[str]) -> list[str]:
    p = len(names)
    return ["grp", "start", "det", *[f"m_{x}" for x in names], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)]]


def concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step from each row of now."""
    names = list(TOLERANCE)
    p = len(names)
    far = rows.join(small(now), "grp").withColumn("far", F.log1p(_distance(names))).select("grp", "start", "far", *names)
    limit = cut(quantile(far, ["grp", "start"], F.col("far"), KEPT, FAR), "limits")
    near = far.join(small(limit), ["grp", "start"]).filter(F.floor(F.col("far") * FAR) <= F.col("slot"))
    sums = near.groupBy("grp", "start").agg(*[F.avg(x).alias(f"m_{x}") for x in names], *[F.covar_pop(a, b).alias(f"v_{a}_{b}") for a, b in combinations_with_replacement(names, 2)])
    sums = sums.withColumns({f"c_{i}_{j}": F.col(f"v_{names[i]}_{names[j]}") * CONSISTENT + (TOLERANCE[names[i]] ** 2 if i == j else 0.0) for i in range(p) for j in range(i, p)})
    return _factor(sums, names).select(*_columns(names))


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """rows: grp and the vector. Returns grp, centre and factor with the least determinant: a row for each group."""
    columns = _columns(list(TOLERANCE))
    # a start's determinant is not that of a subset, so the first step always counts
    now = cut(concentrated(rows, cut(starts(rows), "starts")), "estimates")
    done = now
    for _ in range(steps):
        new = cut(concentrated(rows, now), "estimates")
        was = now.select("grp", "start", F.col("det").alias("was"))
        now = cut(new.join(was, ["grp", "start"]).filter(F.col("det") < F.col("was") * (1 - LESS)).select(*columns), "estimates")
        if now.isEmpty():
            break
        done = done.unionByName(now)
    best = done.groupBy("grp").agg(F.min(F.struct("det", "start", *columns[3:])).alias("x"))
    return best.select("grp", *[f"x.{c}" for c in columns[3:]])


def judge(docs: DataFrame) -> DataFrame:
    """features() with distance2 and kept."""
    rows = cut(features(docs), "features")
    sizes = rows.filter("not base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    own = F.col("n") >= SMALL
    name = F.struct("lang", F.when(own, F.col("source")).alias("source"), own.alias("own"))
    sizes = cut(sizes.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.to_json(name).alias("grp")), "groups")
    rows = rows.join(small(sizes), F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left").drop("of_lang", "of_source")
    found = cut(estimates(rows.filter("not base_failed").select("grp", *TOLERANCE)), "estimates")
    rows = rows.join(small(found), "grp", "left").withColumn("distance2", _distance(list(TOLERANCE)))
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= CUTOFF, F.lit(False)))


def report(docs: DataFrame) -> DataFrame:
    """The digest for each document."""
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2")


def keep_good(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rejected rows."""
    good = judge(docs).filter("kept").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "text_key", "lang", "source")])
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("__text_key"))
    same &= F.col("lang").cast("string").eqNullSafe(F.col("__lang")) & F.col("source").cast("string").eqNullSafe(F.col("__source"))
    return docs.join(good, same, "left_semi")
