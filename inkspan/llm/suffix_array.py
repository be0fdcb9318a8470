"""Suffix-array dedup over bytes with a run-length index.

A match is a string of LENGTH bytes that also starts earlier: in a document with a smaller doc_id, or in the same document
before.

Which places can match at all is found first, by winnowing: each window of LENGTH bytes has an anchor, the leftmost of its
ANCHOR-byte strings with the least hash, so equal windows have equal anchors at equal places. Batches of documents send their
anchors' fingerprints, and learn which occur elsewhere. For each anchor that occurs twice or more, a batch then sends its
contexts: the bytes of all windows that have this anchor, with their place. Contexts that are alike to the last byte (hashes
propose it, the bytes confirm it) are settled on the spot: only those without an earlier copy go on.

The contexts that remain for an anchor differ: edges of shared passages, edits in near copies. They are put in order of their
places and halved again and again: of each half-and-half the earlier contexts are indexed and the later ones streamed, so each
pair of an earlier and a later context meets once. The index (RunIndex) is a run-compressed Burrows-Wheeler transform with the
text places of each run's two ends. A context streams through it from its last byte to its first and carries its matching
statistics: row, one place of the longest match, and its length. Where the row's run has the next byte, an LF step makes the
match longer; else it moves to the nearer ends of the runs of that byte above and below, and keeps as much of the match as the
sampled place there shares with the old one. A window whose match reaches LENGTH is marked.

An anchor with more than HOT different contexts sends single windows in their place, dealt by a hash of the window's bytes: each
batch sends a window once, so what meets in a task grows with the batches and not with the copies.

Null text: no bytes. Null doc_id: later than all others. Rows that share a doc_id, or have none, are documents of their own of
which none is earlier than the other. Texts shorter than LENGTH keep all. Other columns do not matter. Empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, STEP, _VALUES, _upto, batches, by_id, byte_classes, cut, dealt, flat, gather, hash_spans, mix, pack, packets, refine, small_batches, span_hashes, steps, tidy, unpack

LENGTH = 100
ANCHOR = 32
SPREAD = LENGTH - ANCHOR + 1  # anchors a window can have
#: Bytes of text in a batch.
BATCH = 12 << 20
#: Different contexts of an anchor, over all batches, from which on its windows are dealt one by one.
HOT = 50_000
#: Symbols that one index holds.
INDEXED = 1 << 19
#: Bytes of text looked through for anchors at a time, so that what is computed stays in the cache.
PIECE = 1 << 16
#: Bits of a symbol (a byte or a separator), and symbols in the first sort key.
BITS, FIRST = 9, 5


def anchors(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of windows with one anchor: (first window, last window, anchor fingerprint). Windows are named by the place
    of their first byte in data; none crosses an edge."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, np.uint64)
    up, down = _upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    h = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1])
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= SPREAD:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPREAD:
        low = np.minimum(low[: -(SPREAD - width)], low[SPREAD - width :])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the anchor of the window at each byte
    d = np.zeros(len(place) + 1, np.int32)
    np.add.at(d, np.clip(edges - LENGTH + 1, 0, len(place)), 1)
    np.add.at(d, np.clip(edges, 0, len(place)), -1)
    at = np.flatnonzero(np.cumsum(d[:-1]) == 0)  # windows that lie in one row
    if not len(at):
        return none, none, np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = at[new]
    last = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1]
    return first, last, h[place[first]]


class RunIndex:
    """A run-compressed Burrows-Wheeler index over contexts, each in a group of its own choice; a query sees its group only."""

    def __init__(self, data: np.ndarray, size: np.ndarray, group: np.ndarray):
        """data: the contexts' bytes on end; size: their lengths; group: small numbers."""
        ends = np.cumsum(size + 1) - 1  # separators, which differ by their place
        n = int(ends[-1]) + 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = data.astype(np.int64) + 1
        of = np.repeat(group, size + 1)
        self.ranks: list[tuple[int, np.ndarray]] = []  # by the first 5, 10, 20, ... symbols
        rank, tied = self._first_ranks(text, ends, of)
        depth = FIRST
        while True:
            self.ranks.append((depth, rank.astype(np.int32)))
            if not len(tied):
                break
            after = tied + depth  # only what is not told apart yet is sorted again
            tied = refine(rank, tied, np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0))
            depth *= 2
        sa = np.empty(n, np.int64)
        sa[rank] = np.arange(n)
        bwt = text[sa - 1] + (of[sa - 1] << BITS)  # symbols of two groups differ
        head = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        tail = np.append(head[1:], n) - 1
        self.text, self.rows, self.run, self.tail = text, n, head, tail
        self.first, self.last = sa[head], sa[tail]  # text places of the runs' ends
        runs = len(head)
        key = bwt[head] * runs + np.arange(runs)
        order = np.argsort(key)
        self.key = key[order]  # runs by symbol, then by row
        lens = (tail - head + 1)[order]
        self.to = np.cumsum(lens) - lens  # LF of a run's first row
        self.by = order

    @staticmethod
    def _first_ranks(text: np.ndarray, ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks by group and the first symbols (a separator among them tells by its place), and who shares one."""
        n = len(text)
        key, live = of.copy(), np.ones(n, bool)
        for j in range(FIRST):
            symbol = np.zeros(n, np.int64)
            symbol[: n - j] = text[j:]
            key = (key << BITS) | np.where(live, symbol, 0)
            live &= symbol > 0
        rank, every = np.zeros(n, np.int64), np.arange(n)
        tied = refine(rank, every, key)
        near = tied[~live[tied]]
        which = np.zeros(n, np.int64)
        which[near] = 1 + np.searchsorted(ends, near)
        return rank, refine(rank, tied, which[tied])

    def shared(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many symbols the texts at a and b have in common, up to a separator; right up to `most`."""
        off = np.zeros(len(a), np.int64)
        for depth, rank in reversed(self.ranks):
            if depth > most:
                continue
            x, y = np.minimum(a + off, self.rows - 1), np.minimum(b + off, self.rows - 1)
            off += depth * (rank[x] == rank[y])
        like = np.ones(len(a), bool)
        for _ in range(FIRST - 1):
            x = self.text[np.minimum(a + off, self.rows - 1)]
            like &= (x > 0) & (x == self.text[np.minimum(b + off, self.rows - 1)])
            off += like
        return off

    def statistics(self, data: np.ndarray, size: np.ndarray, group: np.ndarray, least: int):
        """Streams contexts (as in __init__) all at once from their last byte to their first. Yields (context, byte in it,
        length) of the longest matches that start there, as long as one of `least` bytes can still come."""
        begin = np.cumsum(size) - size
        who = np.arange(len(size))
        row, place, match = (np.zeros(len(size), np.int64) for _ in range(3))
        place += self.first[0]
        high = (group << BITS) + 1
        runs = len(self.run)
        for back in range(1, int(size.max()) + 1):
            live = (size[who] >= back) & (match + size[who] - back + 1 >= least)  # each step adds one byte at most
            if not live.all():
                who, row, place, match = who[live], row[live], place[live], match[live]
            if not len(who):
                return
            at = size[who] - back
            symbol = high[who] + data[begin[who] + at]
            k = np.searchsorted(self.run, row, "right") - 1
            want = symbol * runs + k
            i = np.searchsorted(self.key, want)
            i_in = np.minimum(i, runs - 1)
            same = self.key[i_in] == want
            go = i_in  # the entry whose run is entered
            inside = row - self.run[k]
            match = match + 1
            other = np.flatnonzero(~same)
            if len(other):
                up, down = i[other] - 1, i_in[other]
                has_up = (up >= 0) & (self.key[up] // runs == symbol[other])
                has_down = (i[other] < runs) & (self.key[down] // runs == symbol[other])
                was, old = match[other] - 1, place[other]
                asked = np.concatenate((np.flatnonzero(has_up), np.flatnonzero(has_down)))
                ends = np.concatenate((self.last[self.by[up[has_up]]], self.first[self.by[down[has_down]]]))
                kept = np.minimum(was[asked], self.shared(old[asked], ends, int(was.max())))
                kept_up, kept_down = np.full(len(other), -1), np.full(len(other), -1)
                kept_up[has_up], kept_down[has_down] = kept[: int(has_up.sum())], kept[int(has_up.sum()) :]
                above = kept_up >= kept_down
                take = np.where(above, up, down)
                run = self.by[take]
                inside[other] = np.where(above, self.tail[run] - self.run[run], 0)
                go[other] = take
                kept = np.maximum(kept_up, kept_down)  # -1: the byte is nowhere in the group, and row and place stay
                place[other] = np.where(kept < 0, old, np.where(above, self.last[run], self.first[run]))
                match[other] = kept + 1
            ok = match > 0
            row = np.where(ok, self.to[go] + inside, row)
            place = np.where(ok, place - 1, place)
            yield who, at, match


def first_places(cls: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, sorted_: bool = False) -> np.ndarray:
    """True for those of a class that none is earlier than: in its least doc_id, the first of each row. sorted_: they are in
    order of their places."""
    out = np.zeros(len(cls), bool)
    order = np.argsort(cls, kind="stable") if sorted_ else np.lexsort((start, row, doc, cls))
    c, d, r = cls[order], doc[order], row[order]
    new = np.ones(len(c), bool)
    new[1:] = c[1:] != c[:-1]
    alone = new.copy()
    alone[1:] |= (r[1:] != r[:-1]) | (d[1:] != d[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(d) else d
    out[order[alone & (d == least)]] = True
    return out


class Contexts:
    """The contexts of a batch: rows in order of doc_id and text, their bytes on end, and for each context its row, place in
    the bytes, size, start in its row, anchor, class, and whether it has no earlier copy in the batch."""

    def __init__(self, table: pa.Table):
        self.table = table = by_id(table)
        self.ids = table["doc_id"].to_numpy()
        self.data, self.off = flat(table["text"])
        found = []
        for a in range(0, len(self.data), PIECE):  # windows that start in a piece; they may end in the next
            piece = self.data[a : a + PIECE + LENGTH - 1]
            lo, hi = np.searchsorted(self.off, [a, a + len(piece)], "right")
            first, last, print_ = anchors(piece, self.off[lo:hi] - a)
            found.append((first + a, last - first + LENGTH, print_, span_hashes(piece, first, last + LENGTH)))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        self.begin, self.size, self.print, h = (np.concatenate(x) for x in zip(*(found or [none])))
        self.row = np.searchsorted(self.off, self.begin, "right") - 1
        self.start = self.begin - self.off[self.row]
        self.cls = byte_classes(self.data, self.begin, self.size, h)
        self.open = first_places(self.cls, self.ids[self.row], self.row, self.start, True)


PRINTS = pa.schema([("bin", pa.int32()), ("batch", pa.int64()), ("prints", pa.binary()), ("counts", pa.binary())])
SHARED = pa.schema([("batch", pa.int64()), ("prints", pa.binary()), ("hot", pa.binary())])
CONTEXTS = pa.schema([("bin", pa.int32()), ("batch", pa.int64()), ("prints", pa.binary()), ("docs", pa.binary()), ("rows", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary()), ("settled", pa.binary())])
SPANS = pa.schema([("batch", pa.int64()), ("spans", pa.binary())])
DDL = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {DDL[f.type]}" for f in schema)


def shared_anchors(rows: DataFrame, n: int, bins: int, hot: int) -> DataFrame:
    """batch, prints, hot: packed fingerprints of the batch's anchors that occur in another batch too; and of those with more
    than `hot` contexts over all."""

    def send(table: pa.Table) -> pa.Table:
        me, c = table["batch"][0].as_py(), Contexts(table)
        print_, count = np.unique(c.print[c.open], return_counts=True)
        out = {f.name: [] for f in PRINTS}
        for where, mine in packets((print_ % np.uint64(bins)).astype(np.int64)):
            for name, x in (("bin", where), ("batch", me), ("prints", pack(print_[mine])), ("counts", pack(count[mine].astype(np.int32)))):
                out[name].append(x)
        tidy()
        return pa.table(out, PRINTS)

    def answer(table: pa.Table) -> pa.Table:
        prints = [unpack(x, np.uint64) for x in table["prints"].to_pylist()]
        every, counts = np.concatenate(prints), np.concatenate([unpack(x, np.int32) for x in table["counts"].to_pylist()])
        _, which, senders = np.unique(every, return_inverse=True, return_counts=True)
        many = np.bincount(which, counts)[which] > hot
        twice = (senders[which] > 1) | many
        out, at = {f.name: [] for f in SHARED}, 0
        for batch, mine in zip(table["batch"].to_pylist(), prints):
            t, m = twice[at : at + len(mine)], many[at : at + len(mine)]
            at += len(mine)
            if t.any():
                for name, x in (("batch", batch), ("prints", pack(mine[t])), ("hot", pack(mine[m]))):
                    out[name].append(x)
        return pa.table(out, SHARED)

    sent = dealt(rows, n).applyInArrow(send, _ddl(PRINTS))
    return cut(dealt(sent, bins, "bin").applyInArrow(answer, _ddl(SHARED)), "anchors")


def earlier_spans(rows: DataFrame, n: int, shared: DataFrame, bins: int) -> DataFrame:
    """batch, spans: packed (row of the batch, from, to) of byte ranges that an earlier place of the corpus has too, found across
    batches and among differing contexts; whole contexts repeated within one batch are left to the batch."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f.name: [] for f in CONTEXTS}
        if not left.num_rows:
            return pa.table(out, CONTEXTS)
        me, c = left["batch"][0].as_py(), Contexts(left)
        asked, hot = (np.concatenate([unpack(x, np.uint64) for x in right[k].to_pylist()] or [np.zeros(0, np.uint64)]) for k in ("prints", "hot"))
        mine = np.flatnonzero(c.open)
        once, count = np.unique(c.print[mine], return_counts=True)
        mine = mine[np.isin(c.print[mine], asked) | np.isin(c.print[mine], once[count > 1])]
        spread = np.isin(c.print[mine], hot)
        begin, size, print_, row = (x[mine[~spread]] for x in (c.begin, c.size, c.print, c.row))
        settled = np.zeros((0, 3), np.int64)
        if spread.any():
            wide = mine[spread]
            count = c.size[wide] - LENGTH + 1
            b = np.arange(int(count.sum())) + np.repeat(c.begin[wide] - (np.cumsum(count) - count), count)
            r, s = np.repeat(c.row[wide], count), np.full(len(b), LENGTH)
            h = hash_spans(c.data, b, s)
            open_ = first_places(byte_classes(c.data, b, s, h), c.ids[r], r, b, True)
            start = (b - c.off[r])[~open_]
            settled = np.stack((r[~open_], start, start + LENGTH), axis=1)
            begin, size, print_, row = (np.concatenate(x) for x in ((begin, b[open_]), (size, s[open_]), (print_, h[open_]), (row, r[open_])))
        order = np.lexsort((begin, row))
        begin, size, print_, row = begin[order], size[order], print_[order], row[order]
        packed = packets((print_ % np.uint64(bins)).astype(np.int64))
        for where, k in packed or ([(me % bins, order[:0])] if len(settled) else []):
            for name, x in (
                ("bin", where), ("batch", me), ("prints", pack(print_[k])), ("docs", pack(c.ids[row[k]])), ("rows", pack(row[k].astype(np.int32))), ("starts", pack(begin[k] - c.off[row[k]])), ("sizes", pack(size[k].astype(np.int32))),
                ("bytes", gather(c.data, begin[k], size[k]).tobytes()), ("settled", settled.tobytes()),
            ):
                out[name].append(x)
            settled = settled[:0]
        tidy()
        return pa.table(out, CONTEXTS)

    def match(table: pa.Table) -> pa.Table:
        got = {k: [unpack(x, kind) for x in table[k].to_pylist()] for k, kind in (("prints", np.uint64), ("docs", np.int64), ("rows", np.int32), ("starts", np.int64), ("sizes", np.int32))}
        sender = np.repeat(np.arange(table.num_rows), [len(x) for x in got["prints"]])
        print_, doc, row, start, size = (np.concatenate(got[k]) for k in ("prints", "docs", "rows", "starts", "sizes"))
        size, row = size.astype(np.int64), row.astype(np.int64)
        owner = (sender << 32) | row  # a row of the corpus
        data = np.frombuffer(b"".join(table["bytes"].to_pylist()), np.uint8)
        begin = np.cumsum(size) - size
        open_ = first_places(byte_classes(data, begin, size, hash_spans(data, begin, size)), doc, owner, start)
        copy = np.flatnonzero(~open_)
        hits = [(copy, start[copy], start[copy] + size[copy])]
        own = np.flatnonzero(open_)
        _, which, count = np.unique(print_[own], return_inverse=True, return_counts=True)
        own, which = own[count[which] > 1], which[count[which] > 1]
        order = np.lexsort((start[own], owner[own], doc[own], which))
        own, which = own[order], which[order]
        for ctx, at in late_windows(data, begin[own], size[own], which, doc[own], owner[own]):
            place = start[own[ctx]] + at
            hits.append((own[ctx], place, place + LENGTH))
        who, lo, hi = _joined(*(np.concatenate([h[k] for h in hits]) for k in range(3)))
        out = {"batch": [], "spans": []}
        by = sender[who]
        for k, (batch, done) in enumerate(zip(table["batch"].to_pylist(), table["settled"].to_pylist())):
            mine = by == k
            if mine.any() or done:
                out["batch"].append(batch)
                out["spans"].append(np.stack((row[who[mine]], lo[mine], hi[mine]), axis=1).tobytes() + done)
        tidy()
        return pa.table(out, SPANS)

    sent = dealt(rows, n).cogroup(dealt(shared, n)).applyInArrow(send, _ddl(CONTEXTS))
    return cut(dealt(sent, bins, "bin").applyInArrow(match, _ddl(SPANS)), "spans")


def _joined(who: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one owner that overlap are put together."""
    order = np.lexsort((lo, who))
    who, lo, hi = who[order], lo[order], hi[order]
    if not len(who):
        return who, lo, hi
    wide = int(hi.max()) + 1
    reach = np.maximum.accumulate(hi + who * wide)
    new = np.concatenate(([True], lo[1:] + who[1:] * wide > reach[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(who)) - 1
    return who[new], lo[new], reach[last] - who[new] * wide


def late_windows(data: np.ndarray, begin: np.ndarray, size: np.ndarray, group: np.ndarray, doc: np.ndarray, owner: np.ndarray, least: int = LENGTH, indexed: int = INDEXED):
    """Contexts in order of group, doc, owner and place. Yields (context, byte in it) of windows of `least` bytes that an earlier
    context of the group has: of a smaller doc, or of the same owner and before."""
    n = len(begin)
    if not n:
        return
    new_group = np.concatenate(([True], group[1:] != group[:-1]))
    edge = {"group": new_group}
    edge["doc"] = edge["group"] | np.concatenate(([True], doc[1:] != doc[:-1]))
    edge["owner"] = edge["doc"] | np.concatenate(([True], owner[1:] != owner[:-1]))
    of = {k: np.cumsum(v) - 1 for k, v in edge.items()}
    first = {k: np.append(np.flatnonzero(v), n) for k, v in edge.items()}
    lo, hi = first["group"][:-1], first["group"][1:]
    nodes = []
    while (big := hi - lo > 1).any():
        lo, hi = lo[big], hi[big]
        mid = (lo + hi) // 2

        def at_edge(kind: str, lo=lo, hi=hi, mid=mid) -> np.ndarray:  # the middle, moved to where a doc or an owner begins
            k = of[kind][mid]
            return np.where(first[kind][k] > lo, first[kind][k], first[kind][k + 1])

        docs, owners = of["doc"][lo] != of["doc"][hi - 1], of["owner"][lo] != of["owner"][hi - 1]
        mid = np.where(docs, at_edge("doc"), np.where(owners, at_edge("owner"), mid))
        meets = docs | ~owners  # rows that share a doc_id do not see each other
        nodes.append((lo[meets], mid[meets], hi[meets]))
        lo, hi = np.concatenate((lo, mid)), np.concatenate((mid, hi))
    if nodes:
        yield from _meet(data, begin, size, *(np.concatenate(x) for x in zip(*nodes)), least, indexed)


def _meet(data: np.ndarray, begin: np.ndarray, size: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray, least: int, indexed: int):
    """Indexes contexts lo..mid of each node, in parts of a bounded size, and streams mid..hi through."""
    count = mid - lo
    early = np.arange(int(count.sum())) + np.repeat(lo - (np.cumsum(count) - count), count)
    node = np.repeat(np.arange(len(lo)), count)
    part = np.cumsum(size[early] + 1) // indexed
    for k in np.unique(part):
        a, b = np.searchsorted(part, [k, k + 1])
        base = int(node[a])
        index = RunIndex(gather(data, begin[early[a:b]], size[early[a:b]]), size[early[a:b]], node[a:b] - base)
        nodes = np.arange(base, int(node[b - 1]) + 1)
        count = hi[nodes] - mid[nodes]
        late = np.arange(int(count.sum())) + np.repeat(mid[nodes] - (np.cumsum(count) - count), count)
        of = np.repeat(nodes - base, count)
        cuts = np.cumsum(size[late]) // (4 * indexed)
        for c in np.unique(cuts):
            x, y = np.searchsorted(cuts, [c, c + 1])
            for who, at, match in index.statistics(gather(data, begin[late[x:y]], size[late[x:y]]), size[late[x:y]], of[x:y], least):
                hit = match >= least
                if hit.any():
                    yield late[x:y][who[hit]], at[hit]


def dedup(docs: DataFrame, batch: int = BATCH, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: the other bytes)."""
    small_batches(docs.sparkSession)
    rows, n = batches(docs, batch)
    bins = n
    shared = shared_anchors(rows, n, bins, hot)
    spans = earlier_spans(rows, n, shared, bins)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Contexts(left)
        done = np.flatnonzero(~c.open)
        named = np.frombuffer(b"".join(right["spans"].to_pylist()), np.int64).reshape(-1, 3)
        row, begin, end = (np.concatenate(x) for x in zip(named.T, (c.row[done], c.start[done], c.start[done] + c.size[done])))
        order = np.argsort(row, kind="stable")
        row, begin, end = row[order], begin[order], end[order]
        del done, named
        out = []
        for first, data, off in steps(c.table["text"], STEP):
            n = len(off) - 1
            a, b = np.searchsorted(row, [first, first + n])
            base = off[row[a:b] - first]
            d = np.zeros(len(data) + 1, np.int32)
            np.add.at(d, base + begin[a:b], 1)
            np.add.at(d, base + end[a:b], -1)
            gone = np.cumsum(d[:-1], dtype=np.int32) > 0
            run = gone.copy()
            run[1:] &= ~gone[:-1]
            edge = off[1:-1][off[1:-1] < len(data)]
            run[edge] = gone[edge]
            n_removed, n_runs = (np.bincount(np.searchsorted(off, np.flatnonzero(x), "right") - 1, minlength=n) for x in (gone, run))
            ends = np.concatenate(([0], np.cumsum(np.diff(off) - n_removed))).astype(np.int64)
            whole = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~gone].tobytes())]).cast(pa.binary())
            my = c.ids[first : first + n]
            out.append(pa.table([pa.array(my, mask=my == NO_ID), pa.array(np.diff(off)), pa.array(n_removed), pa.array(n_runs), whole], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]))
        tidy()
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64())] * 4 + [pa.array([], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return dealt(rows, n).cogroup(dealt(spans, n)).applyInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def report(docs: DataFrame) -> DataFrame:
    """The digest for each document."""
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
