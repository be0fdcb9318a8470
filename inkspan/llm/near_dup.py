"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star-shaped edges.

Each document's set of word shingles is hashed once and dealt into bins; a bin keeps its least hash, and an empty bin
takes the value of another, picked by a hash of the bin and the attempt alone (so two documents with the same empty
bin look at the same places). Bands of bins name buckets. Documents with equal sets form a class at once, found by a
128-bit digest of the set; only the smallest doc_id of a class takes part further.

In a bucket each member is joined to the centre, the smallest doc_id there, so a bucket of n gives n - 1 candidates.
Candidates are confirmed on the full sets. A star can miss a link between two members that both differ from the
centre. So a bucket that still has members of different components, its centre set aside, is looked through once more:
its members' full sets meet, in blocks of bounded size, and links across components are found by products of 0/1
matrices of the shared shingles. A link inside a component changes nothing and is never asked for; only links leave
this step, never candidate pairs. There is no cap.

Components are found by alternating large-star and small-star steps on tables, with partial sums before each shuffle.

Links: 100 * |intersection| >= percent * |union|. Fewer words than a shingle: the whole sequence is one shingle. No words
(or null text): an empty set, linked with nothing. Null doc_id: such rows are compared like the others, with an id
after all others, and reported with null id. Rows that share a doc_id are one node, linked where any of their sets is. Other columns do not matter. Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NO_ID, NOT_SPACE, cut, gram_hashes, id_text, inner_starts, joined_by_key, likely, mix, parts, rows_of, small_batches, span_hashes, steps, word_spans

BINS = 96
BAND = 4
#: Members of a bucket that are compared in one group; two such blocks make the largest.
BLOCK = 1024


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each row, in order of row and hash."""
    s, e, bounds = word_spans(data, off, NOT_SPACE)
    h = span_hashes(data, s, e)
    at = inner_starts(bounds, n)
    row, value = rows_of(bounds)[at], gram_hashes(h, n)[at]
    size = np.diff(bounds)
    for k in range(1, n):  # texts of k words
        short = np.flatnonzero(size == k)
        if len(short):
            acc = np.full(len(short), k, np.uint64)
            for j in range(k):
                acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + h[bounds[short] + j])
            row, value = np.concatenate((row, short)), np.concatenate((value, acc))
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray, rows: int, bins: int = BINS) -> np.ndarray:
    """One-permutation MinHash of each row, densified; shape (rows, bins). Rows without shingles get all ones."""
    sig = np.full((rows, bins), np.iinfo(np.uint64).max, np.uint64)
    h = mix(value + np.uint64(0x51ED270B35C0C2E5))
    slot = (h >> np.uint64(32)).astype(np.int64) % bins
    np.minimum.at(sig.reshape(-1), row * bins + slot, h)
    full = sig != np.iinfo(np.uint64).max
    some = full.any(axis=1)
    attempt = 0
    taken = np.where(full, sig, 0)
    todo_r, todo_b = np.nonzero(~full & some[:, None])
    while len(todo_r):
        attempt += 1
        other = (mix(todo_b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(20)).astype(np.int64) % bins
        ok = full[todo_r, other]
        taken[todo_r[ok], todo_b[ok]] = sig[todo_r[ok], other[ok]]
        todo_r, todo_b = todo_r[~ok], todo_b[~ok]
    taken[~some] = np.iinfo(np.uint64).max
    return taken


def sketches(rows: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (a digest of the set), bands (array of bucket names)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, off in steps(batch.column(1)):
                n = len(off) - 1
                row, value = shingle_sets(LOWER[data], off, shingle)
                sizes = np.bincount(row, minlength=n)
                ends = np.cumsum(sizes)
                digest = []
                for salt in (0x2545F4914F6CDD1D, 0x94D049BB133111EB):
                    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(value ^ np.uint64(salt)))))
                    digest.append((sums[ends] - sums[ends - sizes]).view(np.int64))
                sig = signatures(row, value, n)
                bands = gram_like(sig.reshape(n, -1, BAND))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands.shape[1] + 1, bands.shape[1]), pa.int32()), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(sizes.astype(np.int64)), pa.array(digest[0]), pa.array(digest[1]), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return rows.mapInArrow(sketch, "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def gram_like(x: np.ndarray) -> np.ndarray:
    """A hash of the last axis, with the place of the band in it."""
    acc = np.broadcast_to(np.arange(x.shape[1], dtype=np.uint64), x.shape[:2]).copy()
    for j in range(x.shape[2]):
        acc = mix(acc * np.uint64(0x9FB21C651E98DF25) + x[:, :, j])
    return acc


def full_sets(rows: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node, shingles (binary: sorted 64-bit hashes) of the documents whose id is in wanted (node), and of a few others,
    which cost less than dealing out all texts by id."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, off in steps(batch.column(1)):
                n = len(off) - 1
                row, value = shingle_sets(LOWER[data], off, shingle)
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))) * 8
                raw = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(value.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), raw], ["node", "shingles"])

    mine, _, sharp = likely(rows, F.col("doc_id"), wanted)
    if not sharp:
        mine = mine.join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    return mine.mapInArrow(make, "node long, shingles binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of those pairs whose full sets are alike enough. Both joins deal rows by one side of the pair; a centre
    with very many members is a skewed key of the second, which AQE splits."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("left_set").to_pylist(), batch.column("right_set").to_pylist()
            keep = []
            for x, y in zip(a, b):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right_set"), F.octet_length("shingles").alias("right_n")), "b")
    # sets whose sizes alone rule a link out need no bytes of the other side
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left_set"), F.octet_length("shingles").alias("left_n"))
    both = right.join(left, "a").filter((F.col("left_n") * percent <= F.col("right_n") * 100) & (F.col("right_n") * percent <= F.col("left_n") * 100))
    return both.select("a", "b", "left_set", "right_set").mapInArrow(check, "a long, b long")


def _across(left: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """left: bucket, node, component, n (members of the bucket). Returns a, b: links between members of different
    components, confirmed on full sets. A bucket of more than `block` members is dealt into blocks, and each pair of
    blocks is a group of its own, so no task sees more than two blocks."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    rows = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component")

    def match(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"a": [], "b": []}
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        comp, node, own = (table[c].to_numpy() for c in ("component", "node", "own"))
        names, at, n = np.unique(comp, return_inverse=True, return_counts=True)
        if len(names) < 2:
            return pa.table(out, schema)
        odd = np.flatnonzero(at != np.argmax(n))  # a pair across components has at least one of these
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]]
        size = np.array([len(x) for x in raw])
        doc = np.repeat(np.arange(len(raw)), size)
        _, word, df = np.unique(np.concatenate(raw), return_inverse=True, return_counts=True)
        shared = df[word] > 1
        doc, word = doc[shared], word[shared]
        _, word = np.unique(word, return_inverse=True)
        order = np.argsort(word, kind="stable")
        doc, word = doc[order], word[order]
        common = np.zeros((len(odd), len(raw)), np.float32)
        width = 4096
        for lo in range(0, int(word[-1]) + 1 if len(word) else 0, width):
            a, b = np.searchsorted(word, [lo, lo + width])
            x = np.zeros((len(raw), width), np.float32)
            x[doc[a:b], word[a:b] - lo] = 1
            common += x[odd] @ x.T
        common = common.astype(np.int64)
        like = 100 * common >= percent * (size[odd][:, None] + size[None, :] - common)
        like &= comp[odd][:, None] != comp[None, :]
        if table["i"][0].as_py() != table["j"][0].as_py():  # each pair within one block has its own group
            like &= own[odd][:, None] != own[None, :]
        r, c = np.nonzero(like)
        x, y = node[odd[r]], node[c]
        pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]}, schema)

    return rows.join(sets, "node").groupBy("bucket", "i", "j").applyInArrow(match, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. Returns node, component (the least node reached) for nodes with an edge."""
    e = cut(edges.filter("a <> b").select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).distinct(), "edges")
    last = None
    while True:
        # large star: each node hands its larger neighbours to its least neighbour
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: each node hands itself and its smaller neighbours to the least of these
        large = large.filter("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        e = cut(
            large.join(small, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").filter("u <> v").distinct(),
            "edges",
        )
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reached over links, itself included)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    marks = cut(sketches(rows, shingle), "sketches")
    some = marks.filter("n_shingles > 0")
    # a class's node is its smallest doc_id; hot classes are halved by partial minima before the shuffle
    classes = cut(some.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies")), "classes")
    member = joined_by_key(some.select("doc_id", "set_a", "set_b", "n_shingles"), classes.select("set_a", "set_b", "n_shingles", "node", "copies"), ["set_a", "set_b", "n_shingles"], "copies").drop("copies")
    # buckets with two nodes or more; counting them first keeps lone rows, nearly all, out of what follows
    bucket = classes.select("node", "n_shingles", F.explode("bands").alias("bucket"))
    centre = bucket.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("most"), F.count(F.lit(1)).alias("members"))
    centre = cut(centre.filter("centre < most").select("bucket", "centre", "members"), "centres")
    crowd = cut(joined_by_key(bucket, centre, ["bucket"], "members").drop("members"), "buckets")
    pairs = crowd.filter("node > centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    sets = cut(full_sets(rows, cut(crowd.select("node").distinct(), "nodes"), shingle), "sets")
    links = cut(confirm(pairs, sets, percent), "links")
    comp = cut(components(links), "components")
    # what stars can miss: members of a bucket that lie in different components though the centre is set aside
    left = crowd.filter("node > centre").select("bucket", "node").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = cut(left.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n")).filter("lo < hi").select("bucket", "n"), "mixed")
    left = cut(joined_by_key(left, mixed, ["bucket"], "n"), "mixed")
    more = cut(_across(left, sets, percent), "links")
    if not more.isEmpty():
        comp = cut(components(links.unionByName(more)), "components")
    every = member.join(comp, "node", "left").select("doc_id", "set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    every = every.groupBy("doc_id", "set_a", "set_b", "n_shingles").agg(F.min("component_id").alias("component_id"))
    out = marks.select("doc_id", "n_shingles", "set_a", "set_b").join(every, ["doc_id", "set_a", "set_b", "n_shingles"], "left")
    return out.select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "n_shingles", F.when(F.coalesce("component_id", "doc_id") != NO_ID, F.coalesce("component_id", "doc_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    """The digest for each document: three-word shingles, 85 hundredths."""
    found = near_duplicates(docs, shingle=3, percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, with the smallest doc_id of each component (rows that share a doc_id stay together). Only rows that
    may go meet the ids that go; the others are passed on where they are."""
    gone = cut(near_duplicates(docs, shingle, percent).filter("not (doc_id <=> component_id)").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    key = F.col("doc_id").cast("long")
    some, stay, _ = likely(docs, key, gone)
    return stay.union(some.join(gone, key.eqNullSafe(F.col("__gone")), "left_anti"))
