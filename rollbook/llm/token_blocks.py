"""Token ids on disk in patched frame-of-reference blocks."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import as_text, named, slices
from rollbook.session import run_dir

MAGIC, VERSION = b"PFOR", 1
HEAD = "<4sIIQQ"  # magic, version, ids a block, ids, documents


def _lanes(width: int) -> list[tuple[int, int, int, int]]:
    """Where each of 64 values of this width lies in ``width`` words of 64 bits: value, word, shift, bits in the next."""
    return [(i, i * width // 64, i * width % 64, max(0, i * width % 64 + width - 64)) for i in range(64)]


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of whole numbers below 2**width as rows of bytes, lowest bit first; 64 values at a time fill whole words."""
    rows, block = values.shape
    padded = np.zeros((rows, -(-block // 64) * 64), np.uint64)
    padded[:, :block] = values
    columns = np.ascontiguousarray(padded.reshape(-1, 64).T)
    words = np.zeros((width, columns.shape[1]), np.uint64)
    for i, word, shift, over in _lanes(width) if width else []:
        words[word] |= columns[i] << np.uint64(shift)
        if over:
            words[word + 1] |= columns[i] >> np.uint64(width - over)
    packed = np.ascontiguousarray(words.T).astype("<u8").reshape(rows, -1).view(np.uint8)
    return packed[:, : -(-width * block // 8)]


def _unpack(packed: np.ndarray, width: int, block: int) -> np.ndarray:
    rows = len(packed)
    if not width:
        return np.zeros((rows, block), np.uint32)
    padded = np.zeros((rows, -(-block // 64) * 8 * width), np.uint8)
    padded[:, : packed.shape[1]] = packed
    words = np.ascontiguousarray(padded.view("<u8").reshape(-1, width).T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((64, words.shape[1]), np.uint32)
    for i, word, shift, over in _lanes(width):
        value = words[word] >> np.uint64(shift)
        if over:
            value |= words[word + 1] << np.uint64(width - over)
        out[i] = value & mask
    return np.ascontiguousarray(out.T).reshape(rows, -1)[:, :block]


def _packed_blocks(deltas: np.ndarray, widths: np.ndarray, exceptions: np.ndarray) -> list[bytes]:
    """The body of each block; fills in how many exceptions each has."""
    above = np.zeros(deltas.shape, bool)
    narrow = widths < 32
    above[narrow] = (deltas[narrow] >> widths[narrow, None].astype(np.uint32)) > 0
    exceptions[:] = above.sum(axis=1)
    packed: list[bytes] = [b""] * len(deltas)
    for width in np.unique(widths).tolist():
        which = np.flatnonzero(widths == width)
        low = deltas[which] if width == 32 else deltas[which] & np.uint32((1 << width) - 1)
        for k, body in zip(which.tolist(), _pack(low, width), strict=True):
            packed[k] = body.tobytes()
    for k in np.flatnonzero(exceptions).tolist():
        places = np.flatnonzero(above[k]).astype("<u4")
        high = (deltas[k][places] >> np.uint32(widths[k])).astype("<u4")
        packed[k] += places.tobytes() + high.tobytes()
    return packed


def encode_ids(ids: np.ndarray, lengths: np.ndarray, keys: list[int | None], block: int = 1024, percentile: float = 0.95) -> bytes:
    """A file: head, document table, block index (start, minimum, width, exceptions of each block), blocks.

    From each block its minimum is subtracted. The differences are packed at the width that the chosen
    percentile of them fits; for larger ones the low bits are packed, and their places and high bits follow as
    the block's exception list. The last block is filled with its first id; the head knows the number of ids.
    """
    ids = np.asarray(ids, np.uint32)
    count = -(-len(ids) // block)
    at = min(block - 1, int(np.ceil(percentile * block)) - 1)
    least, widths, exceptions = np.zeros(count, np.uint32), np.zeros(count, np.uint8), np.zeros(count, "<u4")
    packed: list[bytes] = []
    step = max(1, (1 << 19) // block)  # blocks at a time: what packing needs stays small
    for first in range(0, count, step):
        part = ids[first * block : (first + step) * block]
        rows = np.full((-(-len(part) // block), block), part[(len(part) - 1) // block * block], np.uint32)
        rows.reshape(-1)[: len(part)] = part
        here = slice(first, first + len(rows))
        least[here] = rows.min(axis=1)
        deltas = rows - least[here, None]
        edge = np.partition(deltas, at, axis=1)[:, at]
        widths[here] = np.ceil(np.log2(edge.astype(np.float64) + 1)).astype(np.uint8)
        packed += _packed_blocks(deltas, widths[here], exceptions[here])
    starts = np.zeros(count + 1, "<u8")
    starts[1:] = np.cumsum([len(p) for p in packed])
    known = np.array([k is not None for k in keys], np.uint8)
    names = np.array([k or 0 for k in keys], "<i8")
    return b"".join([
        struct.pack(HEAD, MAGIC, VERSION, block, len(ids), len(keys)), known.tobytes(), names.tobytes(),
        np.asarray(lengths).astype("<u8").tobytes(), starts.tobytes(), least.astype("<u4").tobytes(),
        widths.tobytes(), exceptions.tobytes(), *packed,
    ])


class BlockFile:
    """A file of blocks, read as a whole or from any id on."""

    def __init__(self, data: bytes):
        magic, version, self.block, self.n_ids, n_docs = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("no block file")
        self.data, self.at = data, struct.calcsize(HEAD)
        count = -(-self.n_ids // self.block)
        self.known, names, self.lengths = (self._take(t, n_docs) for t in ("u1", "<i8", "<u8"))
        self.keys = [int(k) if ok else None for k, ok in zip(names, self.known, strict=True)]
        self.starts, self.least, self.widths, self.exceptions = (
            self._take(t, n) for t, n in (("<u8", count + 1), ("<u4", count), ("u1", count), ("<u4", count))
        )

    def _take(self, kind: str, count: int) -> np.ndarray:
        out = np.frombuffer(self.data, kind, count, self.at)
        self.at += out.nbytes
        return out

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``; only the blocks that hold them are unpacked."""
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, -(-stop // self.block)
        out = np.zeros((last - first, self.block), np.uint32)
        body = np.frombuffer(self.data, np.uint8, offset=self.at)
        for width in np.unique(self.widths[first:last]).tolist():
            which = first + np.flatnonzero(self.widths[first:last] == width)
            size = -(-width * self.block // 8)
            places = self.starts[which].astype(np.int64)[:, None] + np.arange(size)
            out[which - first] = _unpack(body[places], width, self.block)
        for k in first + np.flatnonzero(self.exceptions[first:last]):
            size, n = -(-int(self.widths[k]) * self.block // 8), int(self.exceptions[k])
            places = np.frombuffer(self.data, "<u4", n, self.at + int(self.starts[k]) + size)
            high = np.frombuffer(self.data, "<u4", n, self.at + int(self.starts[k]) + size + 4 * n)
            out[k - first, places] |= high << np.uint32(self.widths[k])
        out += self.least[first:last, None]
        return out.reshape(-1)[start - first * self.block : stop - first * self.block]


class WordEncoder:
    """The ids of whole texts by the tokenizers library, each distinct word once.

    The tokenizer's pattern never joins two sides of a space between two visible characters, so such pieces
    are encoded alone and remembered, in about ``room`` bytes: when half of them are full the pieces become the older
    ones, and those in use come back from there; the older ones before are forgotten. A text with the string of an added
    token goes to the library as a whole.
    """

    _CUT = re.compile(r"(?<=\S)(?= \S)")
    #: marks behind the last letter of a piece; letters and marks are never one token
    _MARKS = frozenset(".,;:!?|#$%&*)\"-")
    _CLOSE = re.compile(r"(?<=[^\W\d_])[.,;:!?|#$%&*)\"-]+\Z")

    def __init__(self, path: str, room: int = 260_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.room, self.held = room, 0
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cuts = self._cuts_hold()

    def _cuts_hold(self) -> bool:
        """Whether this tokenizer gives pieces the ids they have inside a text; if not, texts stay whole."""
        for text in ("the cat sat.", "a 1 b2 ,c", "x\ny z", "(in) 3.5 \"q\" it's", "été 東京 🙂 ok", "New York\nNew York of the"):
            pieces = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
            found = [i for p in pieces for i in self.tokenizer.encode(p, add_special_tokens=False).ids]
            if found != self.tokenizer.encode(text, add_special_tokens=False).ids:
                return False
        return True

    def _plain(self, text: str) -> list[str] | None:
        """The pieces of a text whose white space is single spaces and line feeds between visible characters."""
        if not self.cuts:
            return None
        if " ".join(text.split()) != text.replace("\n", " ") or "\x00" in text or any(t in text for t in self.added):
            return None
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00") if text else []

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """New plain pieces go to the library many at once, a line each, without their closing marks, so that a word
        is new once; odd ones one by one."""
        known, before = self.known, len(self.known)
        closed = {p: cut for p in plain if p[-1:] in self._MARKS and (cut := self._CLOSE.search(p))}
        lines = {p for p in plain if p not in closed}
        for p, cut in closed.items():
            lines.update((p[: cut.start()], cut[0]))
        lines = [p for p in lines if p not in known and p != "\n"] if len(self.line) == 1 else []
        groups = [lines[i : i + 64] for i in range(0, len(lines), 64)]
        texts = ["\n".join(g) for g in groups]
        for at in range(0, len(groups), 64):
            found = self.tokenizer.encode_batch_fast(texts[at : at + 64], add_special_tokens=False)
            for group, encoding in zip(groups[at : at + 64], found, strict=True):
                ids = np.array(encoding.ids, "<u4")
                cuts = np.flatnonzero(ids == self.line[0])
                if len(cuts) == len(group) - 1:
                    body = ids.tobytes()
                    starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(body)]
                    known.update(zip(group, map(body.__getitem__, map(slice, starts, ends)), strict=True))
        for p, cut in closed.items():
            if p not in known and p[: cut.start()] in known and cut[0] in known:
                known[p] = known[p[: cut.start()]] + known[cut[0]]
        rest = [p for p in (*plain, *odd) if p not in known]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for piece, encoding in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[piece] = np.array(encoding.ids, "<u4").tobytes()
        self._count(before, plain, odd)

    def _count(self, before: int, *pieces: Iterable[str]) -> None:
        """Bytes of the pieces that came: two objects each and their places in the table, besides characters and ids."""
        self.held += 220 * (len(self.known) - before) + sum(sum(map(len, p)) for p in pieces)

    def _known(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text, all of them learnt."""
        split = [self._plain(t) for t in texts]
        odd = []
        for i, pieces in enumerate(split):
            if pieces is None:
                whole = not self.cuts or any(t in texts[i] for t in self.added)
                split[i] = [texts[i]] if whole else self._CUT.split(texts[i])
                odd.append(i)
        others = set().union(*(split[i] for i in odd))
        every = set().union(*split)
        if self.held > self.room // 2:
            self.known, self.older, self.held = {}, self.known, 0
        new = every.difference(self.known)
        if self.older:
            again = new & self.older.keys()
            before = len(self.known)
            self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
            self._count(before, again)
            new -= again
        self._learn(list(new - others), list(new & others))
        return split

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = self._known(texts)
        ids = self.known.__getitem__
        return [b"".join(map(ids, pieces)) for pieces in split]

    def count(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        split = self._known(texts)
        ids = self.known.__getitem__
        return [sum(map(len, map(ids, pieces))) // 4 for pieces in split]


@lru_cache(maxsize=1)
def word_encoder(path: str, room: int = 260_000_000) -> WordEncoder:
    """The encoder of this Python worker: what one task learnt serves the tasks after it. It changes no ids."""
    return WordEncoder(path, room)


MANIFEST = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("file", T.StringType()),
    T.StructField("n_ids", T.LongType()), T.StructField("n_docs", T.LongType()),
])
READ = [T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())]


def write_blocks(
    docs: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2,
    block: int = 1024, percentile: float = 0.95, file_ids: int = 4_000_000, step_bytes: int = 1_500_000,
    room: int = 260_000_000,
) -> DataFrame:
    """Write the ids of every document, each with ``end_id`` behind, in ascending key order (nulls first; equal keys
    by the hash of their text) to block files of about ``file_ids`` ids below ``path``; give back the manifest.

    A null text is empty; repeated rows are documents of their own; an empty table writes no block file; other columns are
    not read. A text of any length goes into one file, which is then larger. Documents are dealt by ranges of the key, so
    a task holds one file's ids at a time; the words learnt take up to about ``room`` bytes of its Python worker. The
    manifest, a table that Spark commits, names the files that count; what a lost attempt leaves is not in it.
    """
    session = docs.sparkSession
    path = reachable(session, path)
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(named(key).cast("long").alias("k"), F.coalesce(named(text), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange(tasks, "k", "h").sortWithinPartitions("k", "h").select("k", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ending = word_encoder(tokenizer, room), np.array([end_id], "<u4").tobytes()
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        bodies: list[bytes] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            ids = np.frombuffer(b"".join(bodies), "<u4")
            lengths = np.array([len(b) // 4 for b in bodies], np.int64)
            name = f"{path}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            _put(name, encode_ids(ids, lengths, keys, block, percentile))
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "seq": seq, "file": name, "n_ids": len(ids), "n_docs": len(keys)}],
                pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]),
            )
            seq += 1
            keys.clear()
            bodies.clear()
            return row

        held = 0
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for at, stop in slices(texts, step_bytes):
                for k, body in zip(names[at:stop], encoder.encode(as_text(texts[at:stop])), strict=True):
                    keys.append(k)
                    bodies.append(body + ending)
                    held += len(bodies[-1]) // 4
                    if held >= file_ids:
                        yield flush()
                        held = 0
        if keys:
            yield flush()

    manifest = f"{path}/manifest"
    rows.mapInArrow(run, MANIFEST).write.parquet(manifest)
    return session.read.schema(MANIFEST).parquet(manifest)


def _filesystem(name: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(name.replace("s3a://", "s3://", 1) if name.startswith("s3a://") else name)


def reachable(session: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark gives it, so that executors and driver mean one place. Block files are written
    and read by the tasks themselves: a scheme that they cannot open is refused here."""
    target = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    scheme = target.toUri().getScheme()
    if scheme is None:
        target = target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).makeQualified(target)
    full = re.sub(r"^file:/+", "file:///", target.toString())
    try:
        _filesystem(full)
    except (pa.ArrowInvalid, NotImplementedError, OSError) as why:
        raise ValueError(f"block files cannot be written to {full}: {why}") from why
    return full


def _put(name: str, data: bytes) -> None:
    system, path = _filesystem(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def _get(name: str) -> bytes:
    system, path = _filesystem(name)
    with system.open_input_file(path) as source:
        return source.read()


def read_blocks(manifest: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """``key``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of every document, from the files.

    Starts are summed in two steps, over the parts and over the files of a part; no ids take part in that. A manifest
    without files gives no rows.
    """
    session = manifest.sparkSession
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("ahead", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part")
    files = files.select("file", (F.col("base") + F.col("ahead")).alias("first"))
    tasks = int(session.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = BlockFile(_get(name))
                ids = held.ids().astype("<u4")
                ends = np.cumsum(held.lengths.astype(np.int64))
                begins = ends - held.lengths.astype(np.int64)
                sums = [zlib.crc32(ids[b:e]) for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.keys, pa.int64()), pa.array(first + begins), pa.array(ends - begins), pa.array(sums, pa.int64())],
                    names=[key, "start", "n_tokens", "ids_crc32"],
                )

    return files.repartition(tasks).mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), *READ]))


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` below the shared folder and read the files back."""
    path = run_dir(docs.sparkSession, "tokens")
    return read_blocks(write_blocks(docs, path, tokenizer, **options), key=options.get("key", "doc_id"))
