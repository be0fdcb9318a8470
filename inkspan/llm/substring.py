"""Substring dedup by prefix-partitioned suffix trees over words.

Each word that starts a window of WINDOW words starts a suffix. Suffixes are split into groups that fit into memory by strings of
variable length from the prefix of WINDOW words: first by their anchor, the least-hash string of GRAM words in it, so that
neighbouring suffixes mostly share a group and travel as one run of words; groups of more than HOT suffixes by the whole prefix, so
there is always something to split by. A group goes to a bin by the hash of its name. A bin builds the subtrees of its groups over
the words themselves: its suffixes in order, with the number of words that neighbours share. Suffixes are cut at WINDOW words, as a
deeper node would say nothing more; the nodes of that depth are the repeats, and the smallest doc_id below one decides which of
its windows are removed. Joined in their documents, these windows are the maximal repeats.

Words travel as bytes, in a dictionary for each packet, so nothing rests on a hash: within a batch windows are alike if their
words are, and words are alike if their bytes are. Hashes only propose likeness and deal work out.

Documents are dealt into batches of about BATCH bytes. To keep suffixes that cannot repeat at home, batches send their anchors
first, with the number of suffixes of each, and learn which occur elsewhere (like windows have like anchors). Of the windows with
such an anchor a batch sends each distinct one once, with the smallest doc_id that has it
there; so a passage in a third of all documents arrives once for each batch, and repeats within a batch are settled on the spot.
Bins name to each batch those that start in a smaller document elsewhere; then the batch is read once more and the covered words
go.

Null text: no words. Null doc_id: later than all others; such rows count as one document, like rows that share a doc_id
(repeated rows remove nothing from each other). Texts of fewer words than the window keep all. Other columns do not matter. Empty
table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    NO_ID, NOT_SPACE, batches, by_id, byte_classes, cover, cut, dealt, exact_classes, flat, gather, gram_hashes, hash_spans, inner_starts, pack, packets, refine, rows_of, small_batches, tidy, unpack, word_spans,
)

WINDOW = 13
#: Words of an anchor.
GRAM = 8
#: Suffixes from which on a group is split by longer prefixes.
HOT = 100_000
#: Bytes of text in a batch.
BATCH = 8 << 20
SPACE = 32


class Subtrees:
    """Subtrees of suffixes, all cut at the same number of words, in the form of arrays: `order` has the suffixes in order of
    their words, `shared` how many words each has in common with the one before."""

    def __init__(self, number: np.ndarray, at: np.ndarray, depth: int):
        """number: the words, by number; at: the first word of each suffix."""
        n = len(at)
        bits = max(1, int(number.max() if len(number) else 0).bit_length())
        per = 61 // bits
        # as many words in a key as it holds; only suffixes that are still alike are sorted again
        rank, tied = np.zeros(n, np.int64), np.arange(n)
        for k in range(0, depth, per):
            key = np.zeros(len(tied), np.int64)
            for j in range(k, min(k + per, depth)):
                key = (key << bits) | number[at[tied] + j]
            tied = refine(rank, tied, key)
        self.order = np.argsort(rank)
        self.shared = np.zeros(n, np.int64)
        like = np.ones(max(0, n - 1), bool)
        for j in range(depth):
            column = number[at[self.order] + j]
            like &= column[1:] == column[:-1]
            self.shared[1:] += like

    def nodes(self, depth: int) -> np.ndarray:
        """The number of the node that each suffix in order is below, at this depth in words; a node of one suffix is a leaf."""
        return np.cumsum(np.concatenate(([True], self.shared[1:] < depth))) - 1 if len(self.order) else np.zeros(0, np.int64)


class Words:
    """A batch's words, their hashes, and the words that start a window."""

    def __init__(self, table: pa.Table, window: int):
        table = by_id(table)
        self.ids, self.window = table["doc_id"].to_numpy(), window
        self.data, off = flat(table["text"])
        self.s, self.e, self.bounds = word_spans(self.data, off, NOT_SPACE)
        self.h = hash_spans(self.data, self.s, self.e - self.s)
        self.at = inner_starts(self.bounds, window)

    def anchors(self, at: np.ndarray) -> np.ndarray:
        """The anchors of the windows at these words."""
        gram = min(GRAM, self.window)
        g, low = gram_hashes(self.h, gram), None
        for k in range(self.window - gram + 1):
            low = g[at + k] if low is None else np.minimum(low, g[at + k])
        return low


class Batch(Words):
    """Words by number; windows by document and class; each class's first window, which is in the smallest document that has it."""

    def __init__(self, table: pa.Table, window: int):
        super().__init__(table, window)
        self.word = byte_classes(self.data, self.s, self.e - self.s, self.h).astype(np.int32)
        self.doc = self.ids[rows_of(self.bounds)[self.at]]
        self.cls = exact_classes(gram_hashes(self.h, window)[self.at], self._alike)
        self.first = np.full(int(self.cls.max()) + 1 if len(self.cls) else 0, -1)
        self.first[self.cls[::-1]] = np.arange(len(self.cls))[::-1]
        if (gap := self.first < 0).any():  # numbers that colliding hashes have left unused
            self.cls, self.first = (np.cumsum(~gap) - 1)[self.cls], self.first[~gap]

    def _alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.at[i], self.at[j]
        out = np.ones(len(a), bool)
        for k in range(self.window):
            out &= self.word[a + k] == self.word[b + k]
        return out

    def sent(self, asked: np.ndarray, hot: np.ndarray, bins: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bin, classes, first words of runs) of the suffixes whose anchor occurs elsewhere; classes in order of their first windows.
        A run is of neighbouring suffixes with one anchor."""
        cls = np.argsort(self.first)
        anchor = self.anchors(self.at[self.first[cls]])
        some = np.isin(anchor, asked)
        cls, anchor = cls[some], anchor[some]
        if not len(cls):
            return []
        at, many = self.at[self.first[cls]], np.isin(anchor, hot)
        name = anchor.copy()
        name[many] = gram_hashes(self.h, self.window)[at[many]]
        return [(b, cls[k], at[k][np.concatenate(([True], (np.diff(at[k]) != 1) | (name[k][1:] != name[k][:-1])))]) for b, k in packets((name % np.uint64(bins)).astype(np.int64))]


PRINTS = pa.schema([("bin", pa.int32()), ("batch", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])
SHARED = pa.schema([("batch", pa.int64()), ("prints", pa.binary()), ("hot", pa.binary())])
SUFFIXES = pa.schema([("bin", pa.int32()), ("batch", pa.int64()), ("words", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary())])
FOUND = pa.schema([("batch", pa.int64()), ("bin", pa.int32()), ("late", pa.binary())])
DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def send_anchors(table: pa.Table, window: int, bins: int) -> pa.Table:
    me, b = table["batch"][0].as_py(), Words(table, window)
    found, count = np.unique(b.anchors(b.at), return_counts=True)
    out = {f.name: [] for f in PRINTS}
    for where, k in packets((found % np.uint64(bins)).astype(np.int64)):
        for name, x in (("bin", where), ("batch", me), ("prints", pack(found[k])), ("counts", pack(count[k].astype(np.int32)))):
            out[name].append(x)
    return pa.table(out, PRINTS)


def answer_anchors(table: pa.Table, hot: int) -> pa.Table:
    """To each batch those of its anchors that another one has, and of these the ones with more than `hot` suffixes over all."""
    prints = [unpack(x, np.uint64) for x in table["prints"].to_pylist()]
    _, which, senders = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    twice = senders[which] > 1
    many = twice & (np.bincount(which, np.concatenate([unpack(x, np.int32) for x in table["counts"].to_pylist()]))[which] > hot)
    out, at = {f.name: [] for f in SHARED}, 0
    for batch, mine in zip(table["batch"].to_pylist(), prints):
        t, m = twice[at : at + len(mine)], many[at : at + len(mine)]
        at += len(mine)
        if t.any():
            for name, x in (("batch", batch), ("prints", pack(mine[t])), ("hot", pack(mine[m]))):
                out[name].append(x)
    return pa.table(out, SHARED)


def _asked(right: pa.Table, column: str) -> np.ndarray:
    found = [unpack(x, np.uint64) for x in right[column].to_pylist() if x is not None]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _upto(sizes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each of these sizes, on end."""
    return np.arange(int(sizes.sum())) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)


def send_suffixes(left: pa.Table, right: pa.Table, window: int, bins: int) -> pa.Table:
    """A packet for each bin: the words of runs of suffixes, a space behind each, and the number of suffixes and the document of
    each run."""
    out = {f.name: [] for f in SUFFIXES}
    if left.num_rows and right.num_rows:
        me, b = left["batch"][0].as_py(), Batch(left, window)
        padded = np.append(b.data, np.uint8(SPACE))
        for bin_, k, begin in b.sent(_asked(right, "prints"), _asked(right, "hot"), bins):
            at = b.at[b.first[k]]
            size = np.diff(np.append(np.searchsorted(at, begin), len(at)))  # suffixes of each run
            word = _upto(size + window - 1, begin)
            lens = b.e[word] - b.s[word] + 1
            text = gather(padded, b.s[word], lens)
            text[np.cumsum(lens) - 1] = SPACE
            row = np.searchsorted(b.bounds, begin, "right") - 1
            for name, x in (("bin", bin_), ("batch", me), ("words", text.tobytes()), ("runs", pack(size.astype(np.int32))), ("docs", pack(b.ids[row]))):
                out[name].append(x)
    tidy()
    return pa.table(out, SUFFIXES)


def search_subtrees(table: pa.Table, window: int) -> pa.Table:
    """To each batch those of the suffixes it sent, by their place in the packet, whose window starts in a smaller document."""
    data = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint8)
    end = np.flatnonzero(data == SPACE)
    begin = np.concatenate(([0], end[:-1] + 1))
    number = byte_classes(data, begin, end - begin, hash_spans(data, begin, end - begin))
    runs, docs = [unpack(x, np.int32).astype(np.int64) for x in table["runs"].to_pylist()], [unpack(x, np.int64) for x in table["docs"].to_pylist()]
    first = np.cumsum([0] + [int(x.sum()) for x in runs])
    runs, docs = np.concatenate(runs), np.concatenate(docs)
    at = _upto(runs, np.cumsum(runs + window - 1) - (runs + window - 1))  # the suffixes' first words
    doc = np.repeat(docs, runs)
    tree = Subtrees(number, at, window)
    node = tree.nodes(window)
    least = np.minimum.reduceat(doc[tree.order], np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))) if len(node) else doc
    late = np.zeros(len(doc), bool)
    late[tree.order] = doc[tree.order] > least[node]
    out = {f.name: [] for f in FOUND}
    for k, (batch, bin_) in enumerate(zip(table["batch"].to_pylist(), table["bin"].to_pylist())):
        mine = np.flatnonzero(late[first[k] : first[k + 1]])
        if len(mine):
            for name, x in (("batch", batch), ("bin", bin_), ("late", pack(mine.astype(np.int32)))):
                out[name].append(x)
    tidy()
    return pa.table(out, FOUND)


def remove_words(left: pa.Table, right: pa.Table, window: int, bins: int) -> pa.Table:
    b = Batch(left, window)
    least = b.doc[b.first]
    late = {bin_: unpack(x, np.int32) for bin_, x in zip(right["bin"].to_pylist(), right["late"].to_pylist()) if x is not None}
    if late:
        for bin_, k, _ in b.sent(_asked(right, "prints"), _asked(right, "hot"), bins):
            if bin_ in late:
                least[k[late[bin_]]] = -(1 << 63)  # a smaller document has it elsewhere
    gone = cover(b.at[b.doc > least[b.cls]], window, len(b.s)) if len(b.at) else np.zeros(len(b.s), bool)
    sums = np.concatenate(([0], np.cumsum(gone)))
    out = pa.table([pa.array(b.ids, mask=b.ids == NO_ID), pa.array(np.diff(b.bounds)), pa.array(sums[b.bounds[1:]] - sums[b.bounds[:-1]]), join_words(b.data, b.s, b.e, b.bounds, ~gone)], ["doc_id", "n_words", "n_removed", "kept"])
    tidy()
    return out


def dedup(docs: DataFrame, window: int = WINDOW, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept (the kept words, joined by one space)."""
    small_batches(docs.sparkSession)
    rows, n = batches(docs, batch)
    bins = n
    sent = dealt(rows, n).applyInArrow(lambda t: send_anchors(t, window, bins), _ddl(PRINTS))
    shared = cut(dealt(sent, bins, "bin").applyInArrow(lambda t: answer_anchors(t, hot), _ddl(SHARED)), "anchors")
    sent = dealt(rows, n).cogroup(dealt(shared, n)).applyInArrow(lambda a, b: send_suffixes(a, b, window, bins), _ddl(SUFFIXES))
    found = cut(dealt(sent, bins, "bin").applyInArrow(lambda t: search_subtrees(t, window), _ddl(FOUND)), "suffixes")
    none = F.lit(None).cast("binary")
    told = shared.select("batch", "prints", "hot", F.lit(None).cast("int").alias("bin"), none.alias("late")).unionByName(found.select("batch", none.alias("prints"), none.alias("hot"), "bin", "late"))
    return dealt(rows, n).cogroup(dealt(told, n)).applyInArrow(lambda a, b: remove_words(a, b, window, bins), "doc_id long, n_words long, n_removed long, kept string")


def join_words(data: np.ndarray, s: np.ndarray, e: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each row, joined by one space."""
    kept = np.flatnonzero(keep)
    row_first = np.searchsorted(kept, bounds)  # kept words before each row
    size = e[kept] - s[kept] + 1  # with the space behind
    last = row_first[1:][np.diff(row_first) > 0] - 1
    size[last] -= 1
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(s[kept] - (ends - size), size)
    text = data[np.minimum(at, len(data) - 1)] if total else np.zeros(0, np.uint8)
    spaced = np.ones(len(kept), bool)
    spaced[last] = False
    text[ends[spaced] - 1] = 32
    off = np.concatenate(([0], ends))[row_first].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.string())


def report(docs: DataFrame) -> DataFrame:
    """The digest for each document."""
    return dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
