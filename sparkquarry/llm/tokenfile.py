"""Token ids in binary shards: a wavelet matrix per shard, one compressed file each.

Tokens are appended document by document in ascending doc_id order, each document's ids followed by an end id.  Range
partitioning by doc_id and a hash of the text orders the tasks, sorting orders the rows in a task, and each task cuts its
stream of documents into shards of a bounded number of ids, so no task holds more than one shard.  A shard keeps, for each
bit of the ids from the highest, one plane of bits: the plane's ids are then parted stably, zeros first.  Planes are
compressed in blocks, and the numbers of ones before each block stand in a directory; so rank and select unpack a block a
plane, and from planes alone follow the id at a place, how often an id occurs before a place, and where its j-th
occurrence is (``Shard.access``, ``rank``, ``select``, ``occurrences``).

A shard file: the magic, a header (numbers of ids, documents and planes, the sizes of the three parts below), then zlib
streams of doc_ids, of document ends, and of the directory (zeros of each plane; sizes and ones of its blocks), then the
blocks, plane by plane, a zlib stream each.  A written manifest names the shards that belong to the output in order; files
of tasks that were lost or repeated are in no manifest.

Defined results: a null or empty text has only the end id; a text of any length is one document, encoded whole, that may
fill a shard by itself; rows with null doc_id come first; rows that share a doc_id
stand side by side, ordered by a hash of the text, then text (so one doc_id with very many rows is split over tasks); an
empty table has an empty manifest; other columns take no part.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import default_path
from .common import bounded, columns_of, shared_dir, shuffle_partitions, written
from .pieces import PieceTable

MAGIC, HEAD = b"WVMX0002", struct.Struct("<8sQQIQQQ")
#: Ids in a shard (a longer document is a shard of its own), bits of a plane's block, blocks that a reader keeps unpacked.
SHARD_IDS, BLOCK, OPEN = 1 << 21, 1 << 17, 64
#: What stands for a null doc_id; pieces with marks between them, and without, that the library takes as one text.
NO_ID, TOGETHER, SHARED = -(1 << 63), 64, 16
#: Bytes of pieces that a worker keeps.
KEPT = 128 << 20


def _deflated(block: np.ndarray) -> bytes:
    """A zlib stream by entropy coding alone: bits of a plane repeat little but are uneven."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    return deflate.compress(block) + deflate.flush()


class Shard:
    """A wavelet matrix over ids, with the documents they belong to.

    blocks: for each plane its compressed blocks.  ones: for each plane the ones before each block and in all.
    """

    def __init__(self, size: int, doc_ids: np.ndarray, ends: np.ndarray, zeros: np.ndarray, blocks: list[list], ones: np.ndarray):
        self.size, self.doc_ids, self.ends, self.zeros, self.blocks, self.ones = size, doc_ids, ends, zeros, blocks, ones
        self.open: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> Shard:
        depth = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        zeros, blocks, ones = [], [], []
        for level in range(depth - 1, -1, -1):
            bits = (now & now.dtype.type(1 << level)) != 0
            plane = np.packbits(bits)
            parts = [plane[k : k + BLOCK // 8] for k in range(0, len(plane), BLOCK // 8)]
            blocks.append([_deflated(p) for p in parts])
            ones.append(np.cumsum([0, *(int(np.bitwise_count(p).sum(dtype=np.int64)) for p in parts)]))
            low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
            zeros.append(len(low))
            now = np.concatenate([now.take(low), now.take(high)])
        return cls(len(ids), doc_ids, ends, np.array(zeros, np.int64), blocks, np.array(ones, np.int64))

    def _block(self, level: int, k: int) -> np.ndarray:
        """A block's bytes."""
        if (level, k) not in self.open:
            if len(self.open) >= OPEN:
                self.open.clear()
            self.open[level, k] = np.frombuffer(zlib.decompress(self.blocks[level][k]), np.uint8)
        return self.open[level, k]

    def _before(self, level: int, place: int) -> int:
        """Ones of a plane before a place."""
        k, rest = divmod(place, BLOCK)
        n = int(self.ones[level, k])
        if rest:
            block = self._block(level, k)
            n += int(np.bitwise_count(block[: rest // 8]).sum(dtype=np.int64))
            n += (int(block[rest // 8]) >> (8 - rest % 8)).bit_count() if rest % 8 else 0
        return n

    def _places(self, level: int, bit: int, js: np.ndarray) -> np.ndarray:
        """Where a plane has its j-th bit of a value, for ascending j from 0."""
        starts = np.minimum(np.arange(self.ones.shape[1]) * BLOCK, self.size)
        before = self.ones[level] if bit else starts - self.ones[level]
        of, out = np.searchsorted(before, js, "right") - 1, np.empty(len(js), np.int64)
        for k in np.unique(of).tolist():
            those = of == k
            bits = np.unpackbits(self._block(level, k), count=int(starts[k + 1] - starts[k]))
            out[those] = starts[k] + np.flatnonzero(bits == bit)[js[those] - before[k]]
        return out

    def access(self, place: int) -> int:
        """The id at a place."""
        out = 0
        for level in range(len(self.blocks)):
            k, rest = divmod(place, BLOCK)
            bit = int(self._block(level, k)[rest // 8]) >> (7 - rest % 8) & 1
            ones = self._before(level, place)
            place = int(self.zeros[level]) + ones if bit else place - ones
            out = out << 1 | bit
        return out

    def _range(self, token: int, place: int) -> tuple[int, int]:
        """Where the id's occurrences before a place stand below the last plane."""
        low, high, depth = 0, place, len(self.blocks)
        if token >> depth:
            return 0, 0
        for level in range(depth):
            a, b = self._before(level, low), self._before(level, high)
            z = int(self.zeros[level])
            low, high = (z + a, z + b) if token >> (depth - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, token: int, place: int | None = None) -> int:
        """How often the id occurs before a place, or at all."""
        low, high = self._range(token, self.size if place is None else place)
        return high - low

    def _up(self, token: int, at: np.ndarray) -> list[int]:
        """The places of what stands at ``at``, ascending, below the last plane: a select in each plane, from the lowest."""
        for level in range(len(self.blocks) - 1, -1, -1):
            bit = token >> (len(self.blocks) - 1 - level) & 1
            at = self._places(level, bit, at - int(self.zeros[level]) if bit else at)
        return at.tolist()

    def select(self, token: int, j: int) -> int:
        """The place of the id's j-th occurrence, from 0."""
        low, high = self._range(token, self.size)
        if not 0 <= j < high - low:
            raise IndexError(f"id {token} occurs {high - low} times")
        return self._up(token, np.array([low + j]))[0]

    def occurrences(self, token: int) -> list[int]:
        """All places of the id, ascending."""
        return self._up(token, np.arange(*self._range(token, self.size)))

    def ids(self) -> np.ndarray:
        """All ids in order: the stable parting of each plane undone, from the lowest."""
        depth = len(self.blocks)
        now = np.zeros(self.size, np.uint16 if depth <= 16 else np.uint32)
        for level in range(depth - 1, -1, -1):
            plane = np.frombuffer(b"".join(map(zlib.decompress, self.blocks[level])), np.uint8)
            ones = np.unpackbits(plane, count=self.size).view(bool)
            z, out = int(self.zeros[level]), np.empty_like(now)
            out[np.flatnonzero(~ones)] = now[:z]
            out[np.flatnonzero(ones)] = now[z:] | now.dtype.type(1 << (depth - 1 - level))
            now = out
        return now

    def to_bytes(self) -> bytes:
        sizes = np.array([[len(b) for b in plane] for plane in self.blocks], "<i8")
        directory = np.concatenate([self.zeros[:, None], sizes.reshape(len(self.blocks), -1), self.ones], axis=1).astype("<i8")
        parts = [zlib.compress(x.tobytes(), 1) for x in (self.doc_ids.astype("<i8"), self.ends.astype("<i8"), directory)]
        return HEAD.pack(MAGIC, self.size, len(self.doc_ids), len(self.blocks), *map(len, parts)) + b"".join([*parts, *(b for plane in self.blocks for b in plane)])

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        magic, size, docs, depth, *sizes = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, parts = HEAD.size, []
        for n in sizes:
            parts.append(zlib.decompress(data[at : at + n]))
            at += n
        n = -(-size // BLOCK)
        directory, view, blocks = np.frombuffer(parts[2], "<i8").reshape(depth, 2 * n + 2), memoryview(data), []
        for level in range(depth):
            cuts = at + np.cumsum([0, *directory[level, 1 : n + 1].tolist()])
            blocks.append([view[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            at = int(cuts[-1])
        return cls(size, np.frombuffer(parts[0], "<i8", docs), np.frombuffer(parts[1], "<i8", docs), directory[:, 0], blocks, directory[:, n + 1 :])


class LibraryCodec:
    """Ids of texts by the tokenizers library, each distinct piece encoded once (see pieces)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a byte is a character in the names of ids
        self.sizes = np.zeros(max(self.library.get_vocab(True).values(), default=0) + 1, np.int64)
        for name, i in self.library.get_vocab(True).items():
            self.sizes[i] = len(name)
        self.pieces = PieceTable(KEPT)

    def _new(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of each piece. Pieces that stand apart as they are share a call's cost: where each ends, the bytes of the ids
        say. Others share one with a special token between, which they do not hold."""
        apart = [p[0] == " " and not p[-1].isspace() for p in pieces]
        plain = self._joined([p for p, a in zip(pieces, apart, strict=True) if a])
        other = self._marked([p for p, a in zip(pieces, apart, strict=True) if not a])
        for a in apart:
            yield next(plain if a else other)

    def _joined(self, pieces: list[str]) -> Iterator[bytes]:
        """The ids of pieces that each begin with a space and end with what is none: one after another they are cut as alone."""
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            made = self.library.encode_batch_fast(["".join(part[j : j + SHARED]) for j in range(0, len(part), SHARED)], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable([e.ids for e in made]), "<u4")
            ends = np.cumsum([len(p.encode()) for p in part])
            bytes_ = np.cumsum(self.sizes[ids])
            at = np.searchsorted(bytes_, ends)
            if len(ids) and bytes_[-1] == ends[-1] and (bytes_[np.minimum(at, len(ids) - 1)] == ends).all():
                raw, cuts = ids.tobytes(), (4 * (at + 1)).tolist()
                yield from [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]
            else:
                # an id whose bytes are not those of the text, or that goes beyond a piece
                yield from self._marked(part)

    def _marked(self, pieces: list[str]) -> Iterator[bytes]:
        by, together = self.special[0] if self.special else "", TOGETHER if self.special else 1
        end = self.library.token_to_id(by) if by else -1
        for k in range(0, len(pieces), 4096):
            part = pieces[k : k + 4096]
            for e in self.library.encode_batch_fast([by.join(part[j : j + together]) for j in range(0, len(part), together)], add_special_tokens=False):
                ids = np.array(e.ids, "<u4")
                raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == end)).tolist()
                yield from [raw[x:y] for x, y in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        plain = [t or "" for t in texts]
        whole = {i for i, t in enumerate(plain) if any(s in t for s in self.special)}
        values = self.pieces.texts([t for i, t in enumerate(plain) if i not in whole], self._new)
        for i, t in enumerate(plain):
            yield np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if i in whole else next(values)


_LOADED: dict[str, LibraryCodec] = {}


def loaded(path: str) -> LibraryCodec:
    """One codec for each Python worker and file."""
    if path not in _LOADED:
        _LOADED[path] = LibraryCodec(path)
    return _LOADED[path]


def write(docs: DataFrame, path: str | None = None, end_id: int = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write docs' ids as shards into the shared folder; the manifest (file, task, part, docs, ids, before), a written table.

    ``before`` is the number of ids in all earlier shards.
    """
    spark, path = docs.sparkSession, path or default_path()
    folder = shared_dir(spark)

    def run(batches):
        codec, end = loaded(path), np.array([end_id], "<u4").tobytes()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        part, held, ids, size = 0, [], [], 0

        def flush():
            name = f"{root}/{task:06d}-{part:06d}-{attempt}.wvmx"
            all_ids = np.frombuffer(b"".join(ids), "<u4")
            ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4)
            with fs.open_output_stream(name, compression=None) as f:
                f.write(Shard.of(all_ids, np.array(held, np.int64), ends).to_bytes())
            return pa.RecordBatch.from_pydict({"file": [name], "task": [task], "part": [part], "docs": [len(held)], "ids": [len(all_ids)]}, schema)

        for b in bounded(batches):
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), codec.ids(b.column("text").to_pylist()), strict=True):
                raw += end
                if held and size + len(raw) // 4 > shard_ids:
                    yield flush()
                    part, held, ids, size = part + 1, [], [], 0
                held.append(NO_ID if doc_id is None else doc_id)
                ids.append(raw)
                size += len(raw) // 4
        if held:
            yield flush()

    schema = pa.schema([("file", pa.string()), ("task", pa.int64()), ("part", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64())])
    # the range's bounds come from a sample of keys: no texts among them
    by = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    ordered = columns_of(docs, "doc_id", "text").repartitionByRange(shuffle_partitions(spark), *by).sortWithinPartitions(*by, F.col("text").asc_nulls_first())
    made = written(ordered.mapInArrow(run, "file string, task long, part long, docs long, ids long"))
    # one row a shard of some million ids: first the tasks' totals, then the shards of a task
    tasks = made.groupBy(F.col("task").alias("_t")).agg(F.sum("ids").alias("_n"))
    tasks = tasks.select("_t", (F.sum("_n").over(Window.orderBy("_t")) - F.col("_n")).alias("_base"))
    inside = Window.partitionBy("task").orderBy("part")
    return made.join(tasks, F.col("task") == F.col("_t")).withColumn("before", F.col("_base") + F.sum("ids").over(inside) - F.col("ids")).drop("_t", "_base").withColumn("folder", F.lit(folder))


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from the shards of a manifest."""

    def run(batches):
        for b in batches:
            for folder, name, before in zip(b.column("folder").to_pylist(), b.column("file").to_pylist(), b.column("before").to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(folder)
                with fs.open_input_stream(name, compression=None) as f:
                    shard = Shard.from_bytes(f.read())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                ends = shard.ends.tolist()
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64(), mask=shard.doc_ids == NO_ID),
                        pa.array([before + s for s in starts], pa.int64()),
                        pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("folder", "file", "before").repartition(shuffle_partitions(manifest.sparkSession), "file")
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
