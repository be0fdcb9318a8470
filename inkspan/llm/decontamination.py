"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the benchmark's windows: 10 consecutive words of an item, or the whole of a shorter item. Patterns of
one length m make one automaton: for blocks of two words (one where m is 1) a shift table tells how far the window
may move on without missing a pattern; a block that ends some pattern has shift 0, and then the hash of the window
picks the bucket of patterns to test, and the words' bytes are compared. The search runs over many stretches of text in lockstep, each a numpy
cursor, so that the skips stay and the interpreter's cost is shared.

The benchmark is a stated query set. It is dealt out by a hash of its rows into blocks of at most BLOCK bytes (a
single longer item makes a longer block), each block's automata are broadcast, and documents are searched once for
each block; hits of several blocks are put together by document.

Null or empty text: no words, no hits; such items never occur. Repeated benchmark rows count as one item if their
item_id is the same; items with the same text each count. Null item_id: its windows hit, but it is not listed.
Repeated documents get a row each. Other columns do not matter. Either table may be empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, STEP, gram_hashes, id_text, inner_starts, small_batches, span_hashes, steps, word_spans

WINDOW = 10
#: Bytes of benchmark text that one broadcast holds.
BLOCK = 16 << 20
#: Words that one cursor searches.
STRETCH = 512
TABLE_BITS = 20


class WuManber:
    """All patterns of one length m over word hashes."""

    def __init__(self, m: int, patterns: np.ndarray):
        """patterns: word hashes, shape (n, m), all different."""
        self.m, self.b = m, 2 if m > 1 else 1
        self.patterns = patterns
        self.shift = np.full(1 << TABLE_BITS, m - self.b + 1, np.uint8 if m < 250 else np.int32)
        for end in range(self.b, m + 1):  # blocks nearer to the end come later and win: they shift less
            block = self.block(patterns[:, end - 2] if self.b == 2 else patterns[:, end - 1], patterns[:, end - 1])
            self.shift[block] = np.minimum(self.shift[block], m - end)
        keys = self.bucket([patterns[:, j] for j in range(m)])
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]

    def block(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = y if self.b == 1 else x * np.uint64(0x9E3779B97F4A7C15) + y
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def bucket(self, columns: list[np.ndarray]) -> np.ndarray:
        acc = columns[0].copy()
        for c in columns[1:]:
            acc = acc * np.uint64(0x9FB21C651E98DF25) + c
        return acc

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, pattern numbers) of the occurrences that lie within one row."""
        m = self.m
        size = np.diff(bounds)
        n = np.maximum(0, -(-(size - m + 1) // STRETCH))  # stretches of each row; they overlap by m - 1 words
        row = np.repeat(np.arange(len(size)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        pos = bounds[row] + k * STRETCH + m - 1  # the window's last word
        stop = np.minimum(pos + STRETCH, bounds[row + 1])
        found, which = [], []
        while len(pos):
            shift = self.shift[self.block(words[pos - 1] if self.b == 2 else words[pos], words[pos])]
            at = pos[shift == 0]
            if len(at):
                keys = self.bucket([words[at - m + 1 + j] for j in range(m)])
                lo, hi = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
                while (live := lo < hi).any():
                    p = self.order[lo[live]]
                    s = at[live] - m + 1
                    same = np.ones(len(s), bool)
                    for j in range(m):
                        same &= words[s + j] == self.patterns[p, j]
                    found.append(s[same])
                    which.append(p[same])
                    lo = lo + 1
            pos = pos + np.maximum(shift, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(found), np.concatenate(which)


class Patterns:
    """The windows of some benchmark rows: an automaton for each length, the items of each window, and its words."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int = WINDOW):
        items, texts = [r[0] for r in rows], pa.array([r[1] for r in rows], pa.large_string())
        self.names = sorted({x for x in items if x is not None})
        number = {x: k for k, x in enumerate(self.names)}
        by_length: dict[int, dict[tuple, tuple[bytes, set]]] = {}
        for row, data, off in steps(texts):
            data = LOWER[data]
            s, e, bounds = word_spans(data, off, ALNUM)
            h = span_hashes(data, s, e)
            raw = data.tobytes()
            for r in range(len(off) - 1):
                a, b = int(bounds[r]), int(bounds[r + 1])
                m = min(window, b - a)
                for p in range(a, b - m + 1) if m else ():
                    bag = by_length.setdefault(m, {}).setdefault(tuple(h[p : p + m].tolist()), (b" ".join(raw[s[i] : e[i]] for i in range(p, p + m)), set()))
                    if items[row + r] is not None:
                        bag[1].add(number[items[row + r]])
        self.automata = []
        for m, found in by_length.items():
            table = WuManber(m, np.array(list(found), np.uint64).reshape(-1, m))
            self.automata.append((table, [w for w, _ in found.values()], [sorted(i) for _, i in found.values()]))

    def search(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[int]]]:
        """Lower-cased text: (row boundaries in words, which words are hit, items found in each row)."""
        s, e, bounds = word_spans(data, off, ALNUM)
        h = span_hashes(data, s, e)
        d = np.zeros(len(s) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for table, words, owners in self.automata:
            at, which = table.search(h, bounds)
            if not len(at):
                continue
            raw = data.tobytes()
            sure = np.fromiter((b" ".join([raw[a:b] for a, b in zip(s[p : p + table.m].tolist(), e[p : p + table.m].tolist())]) == words[k] for p, k in zip(at.tolist(), which.tolist())), bool, len(at))
            at, which = at[sure], which[sure]
            np.add.at(d, at, 1)
            np.add.at(d, at + table.m, -1)
            rows = np.searchsorted(bounds, at, "right") - 1
            for r, k in set(zip(rows.tolist(), which.tolist())):
                items.setdefault(r, set()).update(owners[k])
        return bounds, np.cumsum(d[:-1]) > 0, items


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, item_ids (array, sorted as strings), hits (word number and length of
    each run of hit words). docs: doc_id, text. benchmark: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block) or 1
    bench = bench.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    rows = id_text(docs)
    found = None
    for k in range(n):
        mine = bench.filter(F.col("block") == k).select("item_id", "text").distinct().orderBy("item_id", "text").collect()
        one = _search_block(rows, spark.sparkContext.broadcast(Patterns([tuple(r) for r in mine], window)), n > 1)
        found = one if found is None else found.unionByName(one)
    if n == 1:
        return found.select("doc_id", "n_words", "n_hit", "item_ids", "hits")
    return _together(found, n)


def _search_block(rows: DataFrame, patterns, keyed: bool) -> DataFrame:
    """keyed: adds a hash of the text, so that hits of several blocks meet."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = patterns.value
        for batch in batches:
            for row, data, off in steps(batch.column(1), STEP):
                bounds, hit, items = p.search(LOWER[data], off)
                n = len(off) - 1
                n_words = np.diff(bounds)
                sums = np.concatenate(([0], np.cumsum(hit)))
                n_hit = sums[bounds[1:]] - sums[bounds[:-1]]
                runs = [_runs(hit[bounds[r] : bounds[r + 1]]) if n_hit[r] else [] for r in range(n)]
                names = [sorted(p.names[k] for k in items.get(r, ())) for r in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(n_words), pa.array(n_hit), pa.array(names, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.struct([("word", pa.int64()), ("length", pa.int64())]))), *([batch.column(2).slice(row, n)] if keyed else [])],
                    ["doc_id", "n_words", "n_hit", "item_ids", "hits", *(["text_key"] if keyed else [])],
                )

    schema = "doc_id long, n_words long, n_hit long, item_ids array<string>, hits array<struct<word:long,length:long>>"
    if keyed:
        return rows.withColumn("text_key", F.sha2("text", 256)).mapInArrow(search, schema + ", text_key string")
    return rows.mapInArrow(search, schema)


def _runs(hit: np.ndarray) -> list[dict]:
    d = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    a, b = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
    return [{"word": int(x), "length": int(y - x)} for x, y in zip(a, b)]


def _together(found: DataFrame, blocks: int) -> DataFrame:
    """Hits of several blocks: as many rows for each text as one block gave, with the union of hit words and items."""
    spread = found.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("all_hits"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    merged = F.aggregate(
        "all_hits",
        F.expr("cast(array() as array<struct<word:bigint,length:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (x["word"] <= F.element_at(acc, -1)["word"] + F.element_at(acc, -1)["length"]),
            F.concat(
                F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(acc, -1)["word"].alias("word"), F.greatest(F.element_at(acc, -1)["length"], x["word"] + x["length"] - F.element_at(acc, -1)["word"]).alias("length"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    hits = spread.withColumn("hits", merged).withColumn("row", F.explode(F.sequence(F.lit(1), (F.col("n_rows") / blocks).cast("int"))))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    return hits.withColumn("n_hit", n_hit).select("doc_id", "n_words", "n_hit", "item_ids", "hits")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest for each document."""
    f = find_hits(docs, benchmark)
    return f.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the documents in which a window of the benchmark occurs."""
    bad = find_hits(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__bad")), "left_anti")
