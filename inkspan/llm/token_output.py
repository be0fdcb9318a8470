"""Token-ID / binary output: flat files of unsigned integers with 64-bit document offsets.

Documents are dealt out by ranges of doc_id; each task writes one shard, `<name>.bin` (ids, little-endian, 16 bits
where the vocabulary allows, else 32) and `<name>.idx` (a header of four int64: version, bytes per id, documents,
ids; then doc_ids, then documents + 1 offsets, all int64). A shard's base, the ids before it, is a prefix sum over
the shards' counts, so ids of shard and base together number the whole corpus in ascending doc_id order. A task
writes under a name of its own attempt and renames, so a retried or speculative task leaves one whole file.

Null text: no ids but the end id. Null doc_id: before all others (stored as the least int64). Repeated rows: each
written, ties of doc_id in order of the text. Empty table: no shard. Other columns do not matter.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, id_text, parts, scratch, small_batches, span_hashes, steps

NO_ID = -(1 << 63)
VERSION = 1
#: Pieces of text whose ids a worker keeps at most; a piece beyond is encoded again when it is met again.
KEPT = 3_000_000


class Encoder:
    """The tokenizer over numpy: texts are cut where its own splitting must cut too, and each piece is encoded once.

    Special tokens in a text are taken for what they are, as a plain call does, unless literal_specials says otherwise.
    A cut before a space that a character other than white space follows is always a border of the byte-level
    splitting, and so is one behind a line feed between two ASCII characters that are no white space.
    """

    def __init__(self, path: str, literal_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = literal_specials
        self.kind = np.dtype("<u2") if self.t.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.keys, self.first, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, self.kind)
        self.whole = not self._byte_level() or not self._bound_tokens()

    def _byte_level(self) -> bool:
        import json

        j = json.loads(self.t.to_str())
        return j["normalizer"] is None and (j["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not j["pre_tokenizer"]["add_prefix_space"]

    def _bound_tokens(self) -> bool:
        """Whether no special or added token can reach over a cut."""
        added = self.t.get_added_tokens_decoder().values()
        return not any(x.lstrip or x.rstrip or x.single_word or any(c.isspace() for c in x.content) for x in added)

    def _add(self, keys: np.ndarray, pieces: list[str]) -> None:
        if len(self.keys) > KEPT:
            self.keys, self.first, self.ids = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, self.kind)
        found = [e.ids for k in range(0, len(pieces), 20_000) for e in self.t.encode_batch_fast(pieces[k : k + 20_000], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for f in found for i in f), self.kind, int(sizes.sum()))
        order = np.argsort(all_keys := np.concatenate((self.keys, keys)), kind="stable")
        lens = np.concatenate((np.diff(self.first), sizes))
        begin = np.concatenate((self.first[:-1], len(self.ids) + np.cumsum(sizes) - sizes))[order]
        self.ids = np.concatenate((self.ids, ids))
        self.keys, lens = all_keys[order], lens[order]
        self.ids = self.ids[_ranges(begin, lens)]
        self.first = np.concatenate(([0], np.cumsum(lens)))

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows on end, and how many each row has."""
        if self.whole:
            raw = data.tobytes()
            found = [e.ids for e in self.t.encode_batch_fast([raw[a:b].decode() for a, b in zip(off[:-1], off[1:])], add_special_tokens=False)]
            return np.fromiter((i for f in found for i in f), self.kind), np.fromiter(map(len, found), np.int64, len(found))
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(off) - 1, np.int64)
        after = np.zeros(len(data), np.uint8)  # past the end counts as white space
        after[:-1] = data[1:]
        after[-1] = 32
        plain = _FIRM[after]
        begin = (data == 32) & plain
        begin[2:] |= (data[1:-1] == 10) & _SOLID[data[:-2]] & _SOLID[data[2:]]
        begin[0] = True
        edge = off[1:-1]
        begin[edge[edge < len(data)]] = True
        s = np.flatnonzero(begin)
        e = np.append(s[1:], len(data))
        keys, at, inverse = np.unique(span_hashes(data, s, e), return_index=True, return_inverse=True)
        new = ~np.isin(keys, self.keys, assume_unique=True)
        if new.any():
            raw = data.tobytes()
            self._add(keys[new], [raw[s[i] : e[i]].decode() for i in at[new]])
            if not np.isin(keys, self.keys, assume_unique=True).all():  # the store was emptied
                self._add(keys[~new], [raw[s[i] : e[i]].decode() for i in at[~new]])
        k = np.searchsorted(self.keys, keys)[inverse]
        sizes = self.first[k + 1] - self.first[k]
        total = np.concatenate(([0], np.cumsum(sizes)))
        rows = np.searchsorted(s, off)
        return self.ids[_ranges(self.first[k], sizes)], np.diff(total[rows])


_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_FIRM = np.ones(256, bool)  # a character that begins with this byte is no white space
_FIRM[[*range(0, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def _ranges(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... for each range on end."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(begin - (ends - lens), lens)


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, literal_specials: bool = False) -> Encoder:
    """One for each Python worker, with what it has learnt so far."""
    if (path, literal_specials) not in _encoders:
        _encoders[path, literal_specials] = Encoder(path, literal_specials)
    return _encoders[path, literal_specials]


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1) if path.startswith("file:") else "file://" + path)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int | None, literal_specials: bool = False) -> DataFrame:
    """Writes documents to path in the file format above. Returns a row for each shard: shard, first_id, n_docs,
    n_ids, base. docs: doc_id, text."""
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, ids, counts, n = encoder(tokenizer, literal_specials), None, [], [], 0
        store, root = _store(path)
        task = TaskContext.get()
        name = f"{root}/shard-{task.partitionId():06d}"
        own = f"{name}.{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            doc_ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            if out is None and len(doc_ids):
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{own}.bin")
            for row, data, off in steps(batch.column(1), 4 << 20):
                got, sizes = enc.encode(data, off)
                if end_id is not None:
                    ends = np.cumsum(sizes)
                    got, sizes = np.insert(got, ends, end_id), sizes + 1
                out.write(got.astype(enc.kind, copy=False).tobytes())
                ids.append(doc_ids[row : row + len(sizes)])
                counts.append(sizes)
                n += len(got)
        if out is None:
            return
        out.close()
        ids, counts = np.concatenate(ids), np.concatenate(counts)
        with store.open_output_stream(f"{own}.idx") as f:
            f.write(np.array([VERSION, enc.kind.itemsize, len(ids), n], "<i8").tobytes() + ids.astype("<i8").tobytes() + np.concatenate(([0], np.cumsum(counts))).astype("<i8").tobytes())
        for end in ("bin", "idx"):
            try:
                store.move(f"{own}.{end}", f"{name}.{end}")
            except OSError:  # stores that do not replace on renaming
                store.delete_file(f"{name}.{end}")
                store.move(f"{own}.{end}", f"{name}.{end}")
        yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "first_id": [int(ids[0])], "n_docs": [len(ids)], "n_ids": [n]})

    rows = id_text(docs)
    shards = rows.repartitionByRange(parts(rows), "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard long, first_id long, n_docs long, n_ids long")
    shards = cut(shards, "shards")  # one row a shard, so the window below is small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def open_shard(path: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, offsets, ids) of a shard; ids are memory-mapped where the store is a local or mounted one."""
    from pyarrow import fs

    store, root = _store(path)
    name = f"{root}/shard-{shard:06d}"
    local = isinstance(store, fs.LocalFileSystem)
    idx = np.memmap(f"{name}.idx", "<i8", "r") if local else np.frombuffer(store.open_input_file(f"{name}.idx").read(), "<i8")
    if idx[0] != VERSION:
        raise ValueError(f"{name}.idx: version {idx[0]} is not {VERSION}")
    n, kind = int(idx[2]), f"<u{idx[1]}"
    if int(idx[3]) == 0:
        ids = np.zeros(0, kind)
    else:
        ids = np.memmap(f"{name}.bin", kind, "r") if local else np.frombuffer(store.open_input_file(f"{name}.bin").read(), kind)
    return idx[4 : 4 + n], idx[4 + n : 5 + 2 * n], ids


def read_shards(shards: DataFrame, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in the corpus), n_tokens, ids_crc32 (of its ids as
    little-endian unsigned 32-bit integers)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, base in zip(batch.column("shard").to_pylist(), batch.column("base").to_pylist()):
                doc_ids, off, ids = open_shard(path, shard)
                for k in range(0, len(doc_ids), 10_000):
                    o = off[k : k + 10_001]
                    crc = [zlib.crc32(np.asarray(ids[a:b]).astype("<u4").tobytes()) for a, b in zip(o[:-1], o[1:])]
                    keys = pa.array(doc_ids[k : k + 10_000], mask=np.asarray(doc_ids[k : k + 10_000]) == NO_ID)
                    yield pa.RecordBatch.from_arrays([keys, pa.array(base + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a shard is named by one short row; dealt out so that shards are read in parallel
    return shards.select("shard", "base").repartition(parts(shards)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files (to path, or to a folder in the shared one) and reads them back, a row for each document."""
    path = path or scratch(docs.sparkSession, "ids")
    return read_shards(write_shards(docs, path, tokenizer, end_id), path)
