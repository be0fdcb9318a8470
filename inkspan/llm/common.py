"""What the corpus operators share: scratch tables, partition counts, and vectorised tokenisation of UTF-8 buffers.

Words are found on bytes: every class used by the operators treats all bytes from 0x80 on alike, so a class of
ASCII characters plus "everything else" is decided byte by byte, and a table lookup over the whole Arrow buffer
replaces a regular expression for each text.
"""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of UTF-8 text that one vectorised step handles at a time; numpy holds about 40 times as much.
STEP = 2 << 20
#: Stands for a null doc_id, which is later than all others.
NO_ID = (1 << 63) - 1
#: Batches of documents at least, so that small inputs are worked on in parallel.
LEAST = 8
#: Bits that likely() takes for each id, bits in one of its rows, and bytes that all its rows may have.
FILTER_BITS, PAGE, FILTER = 16, 1 << 15, 32 << 20
#: Removes the shuffle files of an execution when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_WORDS = r"[^\x20\x09-\x0D]+"


# ---- scratch tables -------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of this machine is set
    if the master is local, as in tests; on a cluster that is an error, as no other machine would see the folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="inkspan-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _at(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/inkspan-{name}-{uuid.uuid4().hex}"
    hadoop, store = _at(spark, path)
    store.deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and lost executors cost nothing
    that lies before it. Shuffle files of the write go with it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    found = spark.read.schema(schema).parquet(path)
    found._scratch = path
    return found


def free(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote. Only for those that nothing still to be run reads, not even to be made again."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            hadoop, store = _at(t.sparkSession, path)
            store.delete(hadoop, True)


def small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """df, to be broadcast if its files are known to hold at most limit bytes; else as it is, and joins shuffle."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= limit else df


def joined_by_key(rows: DataFrame, table: DataFrame, keys: list[str], members: str, hot: int = 1000) -> DataFrame:
    """rows joined to table, which has a row for each key and in `members` how many rows the key has. Keys with more than `hot`
    rows would each fill a task: these, few as they are, are joined by broadcast (behind the check of its size), and only the
    others' rows are dealt out by key. table should be one that cut() wrote."""
    names = [c for c in table.columns if c not in keys]
    many = small(cut(table.filter(F.col(members) > hot), "hot")).select(*keys, F.struct(*names).alias("__hot"))
    rows = rows.join(many, keys, "left")
    mine = rows.filter("__hot is not null").select(*[c for c in rows.columns if c != "__hot"], "__hot.*")
    rest = rows.filter("__hot is null").drop("__hot").join(table.filter(F.col(members) <= hot), keys)
    return mine.unionByName(rest)


def likely(rows: DataFrame, key: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """rows whose key (a long) may be among ids, the rows whose key is surely not, and whether the first are sharp: about one
    in FILTER_BITS of those that are not among ids. A bit for the hash of each id, broadcast, so that rows with long texts
    are not dealt out by key only to be told apart. Its size follows the number of ids up to FILTER; beyond that nothing is
    lost, but it is not sharp. ids: one column, which may hold null, and should be a table that cut() wrote."""
    own = F.col(ids.columns[0]).cast("long")
    wanted = ids.count() * FILTER_BITS
    bits = min(max(1, math.ceil(wanted / PAGE)) * PAGE, FILTER * 8)

    def at(c: Column) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(bits))

    pages = F.broadcast(cut(ids.groupBy(F.floor(at(own) / PAGE).alias("__page")).agg(F.bitmap_construct_agg(at(own) % PAGE).alias("__bits")), "filter"))
    place = (at(key) % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = (F.floor(at(key) / PAGE) == F.col("__page")) & (F.getbit(byte, place % 8) == 1)
    return rows.join(pages, hit, "left_semi"), rows.join(pages, hit, "left_anti"), wanted <= bits


def least_hashes(rows: DataFrame, columns: list[str], limit: int) -> DataFrame:
    """`limit` rows (or all, if there are fewer): of the distinct values of columns those with the least hashes, each value
    once however often it is repeated. A bounded, repeatable sample spread over all values. Their number is estimated
    first and only about as many as are wanted reach the ordering, so tasks do not each send a full sample."""
    h = F.xxhash64(*columns)
    n = rows.agg(F.approx_count_distinct(h)).first()[0]
    if n > 2 * limit:
        span = 1 << 63
        rows = rows.filter(h < F.lit(int(-span + 2 * span * min(1.0, 1.5 * limit / n))))
    return rows.dropDuplicates(columns).orderBy(h, *columns).limit(limit)


def parts(df: DataFrame, per: int = 48 << 20) -> int:
    """Partitions for a shuffle of df's rows: the session's setting, or more where the plan's size asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, math.ceil(size / per)) if size < 1 << 58 else least


def batches(docs: DataFrame, per: int) -> tuple[DataFrame, int]:
    """doc_id (null as NO_ID), text (null as empty), batch; and how many batches. A batch holds about `per` bytes of text,
    as measured, whatever the session's number of partitions; LEAST batches at least. Rows are dealt by a hash of
    doc_id and text, so rows that share a doc_id, or have none, are spread."""
    rows = id_text(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(LEAST, math.ceil(size / per))
    return rows.withColumn("batch", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n))), n


def dealt(rows: DataFrame, n: int, key: str = "batch"):
    """rows grouped by key, which has n values. Few large groups dealt to about as many partitions would often meet in one
    task, so there are four partitions for each group, up to 20,000."""
    return rows.repartition(max(1, min(4 * n, 20_000)), key).groupBy(key)


def by_id(table: pa.Table) -> pa.Table:
    """A batch in an order that each run finds again: of doc_id, then text."""
    return table.select(["doc_id", "text"]).sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def small_batches(spark: SparkSession) -> None:
    """Texts are long, so an Arrow batch holds few rows and few bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def id_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id as long and the text with null as empty; other columns go, so clashing names cannot matter."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def tidy() -> None:
    """Gives memory that a group's arrays have left behind back to the machine: Python workers live on between tasks,
    and what they hold on to is missing elsewhere."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


# ---- bytes of an Arrow column -----------------------------------------------------------------------------------


def steps(col: pa.Array | pa.ChunkedArray, limit: int = STEP):
    """Yields (first row, bytes, offsets) of consecutive rows with about limit bytes; a longer text comes alone."""
    row = 0
    for chunk in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        if not len(chunk):
            continue
        chunk = chunk.cast(pa.large_binary())
        _, off, data = chunk.buffers()
        off = np.frombuffer(off, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(chunk):
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
            b = min(b, len(chunk))
            yield row + a, data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b
        row += len(chunk)


def flat(col: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column on end, and row boundaries in them."""
    whole = pa.chunked_array([c.cast(pa.large_binary()) for c in col.chunks] or [pa.array([], pa.large_binary())]).combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    _, off, data = whole.buffers()
    if not len(whole) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    off = np.frombuffer(off, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[begin:begin + size] of all, on end."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def refine(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Tells those of `tied` that share a rank apart by their keys. A rank is the number of smaller ones, so those of other ranks
    keep theirs. Returns who still shares one."""
    if not len(tied):
        return tied
    was = rank[tied]
    wide = int(key.max()) + 1
    if int(was.max()) * wide + wide < 1 << 62:
        both = was * wide + key
        order = np.argsort(both)
        both = both[order]
        new_key = np.concatenate(([True], both[1:] != both[:-1]))
        old = was[order]
    else:
        order = np.lexsort((key, was))
        old, k = was[order], key[order]
        new_key = np.concatenate(([True], (old[1:] != old[:-1]) | (k[1:] != k[:-1])))
    new_rank = np.concatenate(([True], old[1:] != old[:-1]))
    at = np.arange(len(order))
    begin = np.maximum.accumulate(np.where(new_key, at, 0))
    rank[tied[order]] = old + begin - np.maximum.accumulate(np.where(new_rank, at, 0))
    alone = new_key & np.append(new_key[1:], True)
    return tied[order[~alone]]


def packets(where: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(bin, members in their order) for each bin that has any."""
    order = np.argsort(where, kind="stable")
    s = where[order]
    cuts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))) if len(s) else np.zeros(1, np.int64)
    return [(int(s[a]), order[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def exact_classes(h: np.ndarray, alike) -> np.ndarray:
    """A class for each entry; entries of a class are the same. h: hashes, alike for like entries; alike(i, j): whether entries
    i and j are the same, which settles what the hashes propose."""
    out, todo, used = np.zeros(len(h), np.int64), np.arange(len(h)), 0
    while len(todo):
        order = np.argsort(h[todo])
        s = h[todo][order]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        which = np.empty(len(todo), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        head = todo[first[which]]
        same = head == todo
        copy = np.flatnonzero(~same)
        same[copy] = alike(head[copy], todo[copy])
        out[todo[same]] = used + which[same]
        used += len(first)
        todo = todo[~same]  # others that share a hash
    return out


def byte_classes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    """exact_classes of the byte strings data[begin:begin + size], none of them empty."""

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = size[i] == size[j]
        at = np.flatnonzero(out)
        ends, lo = np.cumsum(size[i[at]]), 0
        while lo < len(at):
            s = size[i[at[lo]]]
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - s + STEP, "right")))
            k = at[lo:hi]
            s = size[i[k]]
            unlike = gather(data, begin[i[k]], s) != gather(data, begin[j[k]], s)
            out[k] = ~np.logical_or.reduceat(unlike, np.cumsum(s) - s)
            lo = hi
        return out

    return exact_classes(h, alike)


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(9, 14)]] = False
#: Digits, lower-case letters and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_MASK = (1 << 64) - 1
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _upto(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(16, n - 1).bit_length() if n > 1 << 16 else 1 << 16
        for k, base in enumerate((_R, _R_INV)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate((p, p * np.uint64(pow(base, len(p), 1 << 64))))
            _powers[k] = p
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads each bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e], alike for like bytes wherever they stand."""
    if not len(s):
        return np.zeros(0, np.uint64)
    up, down = _upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """span_hashes in pieces, so that memory stays bounded. begin ascends."""
    found = np.zeros(len(begin), np.uint64)
    a = 0
    while a < len(begin):
        b = max(a + 1, int(np.searchsorted(begin, begin[a] + STEP // 8)))
        lo, hi = begin[a], begin[b - 1] + size[b - 1]
        found[a:b] = span_hashes(data[lo:hi], begin[a:b] - lo, begin[a:b] + size[a:b] - lo)
        a = b
    return found


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and off-like row boundaries in words; words never cross rows."""
    inside = table[data]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    start[edge] = inside[edge]
    end[edge - 1] = inside[edge - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive entries, one for each start."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = words[:m].copy()
    for j in range(1, n):
        acc *= np.uint64(0x9FB21C651E98DF25)
        acc += words[j : j + m]
    return mix(acc)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each entry, given row boundaries in entries."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def inner_starts(bounds: np.ndarray, n: int) -> np.ndarray:
    """Starts of n consecutive entries that lie in one row."""
    total = int(bounds[-1])
    ok = np.ones(max(0, total - n + 1), bool)
    for b in range(1, n):
        at = bounds[1:-1] - b
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return np.flatnonzero(ok)


def pack(a: np.ndarray) -> bytes:
    """Fixed-width integers, plane by plane, so that a shuffle's compression finds the planes that hardly change."""
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def unpack(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def cover(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """True at each of total places that lies within width of a start."""
    d = np.zeros(total + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, total), -1)
    return np.cumsum(d[:-1]) > 0
