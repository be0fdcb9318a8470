"""LM scoring by prediction with partial matching over bytes.

The model is a trie of byte contexts up to ORDER symbols, kept as a table of (ORDER + 1)-grams with their counts in
the training documents; shorter contexts are sums over it, as each text is preceded by ORDER border symbols and ended by
one. Escape follows method C: at a context seen n times with d distinct symbols, a new symbol has share d / (n + d).
Symbol exclusion is exact: what a context has seen was also seen by its suffix, so the mass that a shorter context
loses to exclusion is a sum over the longer one's symbols, one number for each context, found by joining the table of
one order to that of the next. Thus the log probability of a symbol after a context is a function of the gram alone;
it is computed once for each distinct gram of the corpus and summed over the texts.

A text's score is the sum over its bytes and the end. The baseline is a unigram model over lower-cased words.

Documents are dealt into batches of about BATCH bytes by a hash of doc_id and text. A batch sends its distinct grams and words with their
counts in training documents; both tables are summed by key (a key from every batch is one row a batch, however
frequent it is) and what the batch needs to know comes back to it. So what is gathered grows with the corpus, and no
table is broadcast.

Null text: empty; it still has its end. Null doc_id: its row hashes like the text null, and is reported with null.
Repeated rows: each scored and each counted. Empty training set: all symbols alike, unigram over no tokens. Other
columns do not matter. Empty table: empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, NOT_SPACE, batches, by_id, cut, dealt, free, pack, small_batches, span_hashes, steps, tidy, unpack, word_spans

ORDER = 5
#: Bits of a symbol: a byte, or the border.
BITS = 9
BORDER = 256
SYMBOLS = 257
FOLDS, HELD_OUT = 5, 1
#: Bytes of text in a step: each has a gram of eight bytes and a few temporaries of that size.
STEP = 1 << 19
#: Bytes of text in a batch.
BATCH = 16 << 20
END = np.uint64(0x7FFFFFFFFFFFFFF1)  # stands for the end token among word hashes


def grams(data: np.ndarray, off: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The (order + 1)-grams of all rows, one for each byte and each end, and row boundaries in them."""
    n = np.diff(off)
    pad = order + 1
    begin = off[:-1] + pad * np.arange(len(n))  # each row: order borders, its bytes, a border
    text = np.full(len(data) + pad * len(n), BORDER, np.int64)
    if len(data):
        at = np.arange(len(data)) + np.repeat(begin + order - off[:-1], n)
        text[at] = data
    acc = np.zeros(max(0, len(text) - order), np.int64)
    for j in range(order + 1):
        acc <<= BITS
        acc |= text[j : len(text) - order + j]
    bounds = np.concatenate(([0], np.cumsum(n + 1)))
    keep = np.arange(int(bounds[-1])) + np.repeat(begin - bounds[:-1], n + 1)
    return acc[keep], bounds


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's words and its end, and row boundaries in them."""
    s, e, bounds = word_spans(data, off, NOT_SPACE)
    h = span_hashes(data, s, e)
    return np.insert(h, bounds[1:], END), bounds + np.arange(len(bounds))


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"null" if i == NO_ID else str(i).encode()) % FOLDS == HELD_OUT for i in ids.tolist()], bool)


def _counted(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    keys, which = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(which, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)


def _of_batch(table: pa.Table, order: int):
    ids = table["doc_id"].to_numpy()
    out = held_out(ids)
    for row, data, off in steps(table["text"], STEP):
        low = LOWER[data]
        g, gb = grams(low, off, order)
        w, wb = tokens(low, off)
        my = out[row : row + len(off) - 1]
        yield row, g, gb, w, wb, my


def collect(rows: DataFrame, n: int, order: int, bins: int) -> tuple[DataFrame, DataFrame]:
    """(batch, gram, n) and (bin, batch, words, counts): each batch's distinct grams, and packed words, with their
    counts in training documents, which may be zero."""

    def send(table: pa.Table) -> pa.Table:
        me = table["batch"][0].as_py()
        gs, ws = [], []
        for _, g, gb, w, wb, out in _of_batch(by_id(table), order):
            for mine, all_, bounds in ((gs, g, gb), (ws, w, wb)):
                held = np.repeat(out, np.diff(bounds))
                mine.append(np.unique(all_[~held], return_counts=True))
                other = np.unique(all_[held])
                mine.append((other, np.zeros(len(other), np.int64)))
                if len(mine) > 8:  # so that a batch's distinct keys are held about once
                    mine[:] = [_counted(mine)]
        g, gn = _counted(gs)
        w, wn = _counted(ws)
        del gs, ws
        where = (w % np.uint64(bins)).astype(np.int64)
        o = np.argsort(where, kind="stable")
        w, wn, where = w[o], wn[o], where[o]
        cuts = np.flatnonzero(np.concatenate(([True], np.diff(where) > 0, [True])))
        out = {"batch": [me], "bin": [None], "keys": [pack(g)], "counts": [pack(gn)]}
        for a, b in zip(cuts[:-1], cuts[1:]):
            out["batch"].append(me)
            out["bin"].append(int(where[a]))
            out["keys"].append(pack(w[a:b]))
            out["counts"].append(pack(wn[a:b].astype(np.int32)))
        del g, gn, w, wn, where, o
        tidy()
        return pa.table(out, pa.schema([("batch", pa.int64()), ("bin", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())]))

    return cut(dealt(rows, n).applyInArrow(send, "batch long, bin int, keys binary, counts binary"), "counts")


def unpacked(counts: DataFrame) -> DataFrame:
    """batch, gram, n: a row for each distinct gram of a batch."""

    def rows(it):
        for batch in it:
            for r in range(batch.num_rows):
                me, k, c = (batch.column(x)[r].as_py() for x in ("batch", "keys", "counts"))
                k, c = unpack(k, np.int64), unpack(c, np.int64)
                for a in range(0, len(k), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k[a : a + 20_000]), me)), pa.array(k[a : a + 20_000]), pa.array(c[a : a + 20_000])], ["batch", "gram", "n"])
            tidy()

    # few long rows: dealt out, so that they are taken apart in parallel
    grams_ = counts.filter("bin is null").select("batch", "keys", "counts")
    return grams_.mapInArrow(rows, "batch long, gram long, n long")


def code_lengths(totals: DataFrame, order: int) -> DataFrame:
    """totals: gram, n, a row for each distinct gram. Returns gram, logp: log10 of its last symbol's probability."""
    part = lambda k: F.col("gram").bitwiseAND(F.lit((1 << BITS * (k + 1)) - 1))  # noqa: E731  the suffix with a context of k
    levels, nodes = {order: totals.select("gram", "n")}, {}
    for k in range(order - 1, -1, -1):
        levels[k] = cut(levels[k + 1].groupBy(part(k).alias("gram")).agg(F.sum("n").alias("n")), "grams")
    for k in range(order + 1):
        # mass and kinds: how often the context was seen, with how many symbols; masked: what these symbols weigh in
        # the context one shorter, which exclusion takes from it
        seen = levels[k].filter("n > 0").withColumn("ctx", F.shiftright("gram", BITS))
        if k:
            seen = seen.withColumn("low", part(k - 1)).join(levels[k - 1].select(F.col("gram").alias("low"), F.col("n").alias("low_n")), "low")
        else:
            seen = seen.withColumn("low_n", F.lit(0).cast("long"))
        nodes[k] = cut(seen.groupBy("ctx").agg(F.sum("n").alias("mass"), F.count(F.lit(1)).alias("kinds"), F.sum("low_n").alias("masked")), "nodes")
    zero = F.lit(0).cast("long")
    live, held = levels[order].select("gram", F.col("gram").alias("top"), F.lit(1.0).alias("escape"), zero.alias("x_mass"), zero.alias("x_kinds")), None
    done = []
    for k in range(order, -1, -1):
        live = live.join(levels[k], "gram").withColumn("ctx", F.shiftright("gram", BITS)).join(nodes[k], "ctx", "left").fillna(0, ["mass", "kinds", "masked"])
        fresh = F.col("kinds") - F.col("x_kinds")
        total = F.col("mass") - F.col("x_mass") + fresh
        # a gram seen in training is done and keeps its code only; of an open one stays what the shorter context needs
        p = F.when(F.col("n") > 0, F.col("escape") * F.col("n") / total)
        escape = F.when(fresh > 0, F.col("escape") * fresh / total).otherwise(F.col("escape"))
        open_ = F.col("n") <= 0
        table = cut(live.select("top", F.log10(p).alias("logp"), *[F.when(open_, c).alias(name) for name, c in (("escape", escape), ("x_mass", F.col("masked")), ("x_kinds", F.col("kinds")))]), "codes")
        free(levels[k], nodes[k])
        done.append(table.filter("logp is not null").select(F.col("top").alias("gram"), "logp"))
        live = table.filter("logp is null").select(F.col("top").bitwiseAND(F.lit((1 << BITS * max(k, 1)) - 1)).alias("gram"), "top", "escape", "x_mass", "x_kinds")
    done.append(live.select(F.col("top").alias("gram"), F.log10(F.col("escape") / F.greatest(F.lit(SYMBOLS) - F.col("x_kinds"), F.lit(1))).alias("logp")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def word_totals(counts: DataFrame) -> tuple[DataFrame, int, int]:
    """(batch, keys, counts) with the corpus's counts of each batch's words; all training tokens; distinct ones."""

    def add(table: pa.Table) -> pa.Table:
        keys = [unpack(x, np.uint64) for x in table["keys"].to_pylist()]
        every = np.concatenate(keys)
        distinct, which = np.unique(every, return_inverse=True)
        n = np.bincount(which, np.concatenate([unpack(x, np.int32) for x in table["counts"].to_pylist()]), len(distinct)).astype(np.int64)
        ends = np.cumsum([len(k) for k in keys])
        out = {"batch": table["batch"].to_pylist(), "keys": table["keys"].to_pylist(), "counts": [pack(n[which[e - len(k) : e]]) for k, e in zip(keys, ends)], "mass": [None] * len(keys), "kinds": [None] * len(keys)}
        for name, x in (("batch", None), ("keys", None), ("counts", None), ("mass", int(n.sum())), ("kinds", int((n > 0).sum()))):
            out[name].append(x)
        del keys, every, distinct, which, n
        tidy()
        return pa.table(out, pa.schema([("batch", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("mass", pa.int64()), ("kinds", pa.int64())]))

    words = counts.filter("bin is not null").groupBy("bin").applyInArrow(add, "batch long, keys binary, counts binary, mass long, kinds long")
    words = cut(words, "words")
    mass, kinds = words.agg(F.sum("mass"), F.sum("kinds")).first()
    return words.filter("batch is not null").select("batch", "keys", "counts"), int(mass or 0), int(kinds or 0)


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes."""
    small_batches(docs.sparkSession)
    rows, n = batches(docs, BATCH)
    counts = collect(rows, n, order, 3 * n)
    mine = unpacked(counts)
    totals = cut(mine.groupBy("gram").agg(F.sum("n").alias("n")), "totals")
    codes = code_lengths(totals, order)
    free(totals)
    words, mass, kinds = word_totals(counts)
    none = F.lit(None)
    asked = mine.select("batch", "gram").join(codes, "gram").select("batch", "gram", "logp", none.cast("binary").alias("keys"), none.cast("binary").alias("counts"))
    asked = asked.unionByName(words.select("batch", none.cast("long").alias("gram"), none.cast("double").alias("logp"), "keys", "counts"))

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        table = by_id(left)
        ids = table["doc_id"].to_numpy()
        packed = right["keys"].is_valid()
        found = right.filter(packed)
        keys = np.concatenate([unpack(x, np.uint64) for x in found["keys"].to_pylist()] or [np.zeros(0, np.uint64)])
        cs = np.concatenate([unpack(x, np.int64) for x in found["counts"].to_pylist()] or [np.zeros(0, np.int64)])
        known_words = pd.Index(keys)
        found = right.filter(pa.compute.invert(packed))
        known_grams, logp = pd.Index(found["gram"].to_numpy()), found["logp"].to_numpy()
        floor = math.log10(mass + 0.5 * (kinds + 1))
        out = []
        for row, g, gb, w, wb, held in _of_batch(table, order):
            my = ids[row : row + len(held)]
            c = cs[known_words.get_indexer(w)]  # hashed look-ups: a fifth of a binary search's time
            base = np.add.reduceat(np.log10(c + 0.5) - floor, wb[:-1])
            known = np.add.reduceat((c > 0).astype(np.int64), wb[:-1])
            value = np.add.reduceat(logp[known_grams.get_indexer(g)], gb[:-1])
            out.append(pa.table([pa.array(my, mask=my == NO_ID), pa.array(held), pa.array(np.diff(wb)), pa.array(known), pa.array(np.full(len(my), mass)), pa.array(base), pa.array(value), pa.array(np.diff(gb) - 1)], NAMES))
        tidy()
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in TYPES], NAMES)

    return dealt(rows, n).cogroup(dealt(asked, n)).applyInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"]
TYPES = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2, pa.int64()]


def report(docs: DataFrame) -> DataFrame:
    return score(docs)
