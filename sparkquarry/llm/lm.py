"""Language-model scores by deleted interpolation (Jelinek and Mercer 1980).

P_n(w | h) = l * c(h w) / c(h) + (1 - l) * P_{n-1}(w | shorter h), down to 1 / (V + 1).  The weight l depends on the order n
and on the bucket of c(h), its power of two.  One in DELETED of the documents to learn from is set aside: weights are
learned by expectation-maximisation on its words with counts of the others, then counts of all are used.

Texts are numbered once, in blocks of BLOCK tokens, into a written table of a few bytes a token.  For each order a block
asks for its distinct n-grams, as sorted hashes of 64 bits with their counts in the block, dealt out by ranges of the
hash, so each n-gram meets its like from all blocks in one bucket, and comes at most once from a block however frequent
it is.  Buckets answer with corpus counts in the order asked; blocks and their answers meet by block.  From the third
order on, only n-grams whose two parts both recur are asked for: others occur once, where they stand.  Nothing but
totals, and a weight for each order and bucket, reaches the driver; buckets grow in number with the tokens.

Two n-grams among the corpus' 10^12 share a hash with a chance of some 10^-7 each, and would share their counts.

Defined results: null, empty and blank texts are the end token alone; texts of any length are scored whole, one text being
held as words at a time; rows are rows: repeated ones are each learned from and scored; a null doc_id is neither held out
nor learned from; without anything to learn from, base_score is 0 and so is score; an empty table gives no rows; other
columns take no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_of, groups, shuffle_partitions, written

#: Words of an n-gram; folds and the one that is held out; one in how many training documents learns the weights.
ORDER, FOLDS, HELD_OUT, DELETED = 2, 7, 2, 16
#: Tokens of a block and of a bucket; rounds of expectation-maximisation, and the change of a weight that ends them.
BLOCK, BUCKET, ROUNDS, SETTLED = 1 << 20, 4 << 20, 16, 1e-3
#: The end token: no word holds a space. What stands before a text.
_END, _START = b" ", np.uint64(0x5851F42D4C957F2D)
_BLOCK_COLUMNS = "block long, deleted boolean, doc_id array<long>, held_out array<boolean>, train array<boolean>, n array<int>, words binary, tokens binary"
_ANSWER_COLUMNS = "block long, kind int, bucket int, deleted boolean, counts binary, gone binary, often binary, types long, total long, kept long"


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, those of equal weight together, compressed."""
    raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
    return len(a).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(b[8:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


class _Open:
    """A block that still takes documents."""

    def __init__(self):
        self.docs, self.tokens, self.size = [], [], 0
        self.ids: defaultdict = defaultdict(count().__next__)

    def add(self, rows: list[tuple], words: list[bytes]) -> None:
        self.docs += rows
        self.tokens.append(np.fromiter(map(self.ids.__getitem__, words), np.uint32, len(words)))
        self.size += len(words)

    def row(self, block: int, deleted: bool) -> pa.RecordBatch:
        """Frequent words get small numbers."""
        t = np.concatenate(self.tokens)
        order = np.argsort(-np.bincount(t, minlength=len(self.ids)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.ids), np.uint64, len(self.ids))[order]
        doc_id, held_out, train, n = zip(*self.docs, strict=True)
        row = {"block": block, "deleted": deleted, "doc_id": doc_id, "held_out": held_out, "train": train, "n": n, "words": packed(hashes), "tokens": packed(rank[t])}
        kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], [*row])


def blocks_of(docs: DataFrame) -> DataFrame:
    """A row for each block of numbered texts, those that learn the weights apart from the others; a written table."""

    def run(batches):
        number = count(TaskContext.get().partitionId() << 32)
        open_ = {False: _Open(), True: _Open()}
        for b in bounded(batches):
            rows, words = {False: [], True: []}, {False: [], True: []}
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                h = None if i is None else zlib.crc32(str(i).encode())
                train = h is not None and h % FOLDS != HELD_OUT
                deleted = train and h // FOLDS % DELETED == 0
                own = (text or b"").lower().split()
                own.append(_END)
                rows[deleted].append((i, h is not None and not train, train, len(own)))
                words[deleted] += own
            for deleted, block in open_.items():
                if rows[deleted]:
                    block.add(rows[deleted], words[deleted])
                if block.size >= BLOCK:
                    yield block.row(next(number), deleted)
                    open_[deleted] = _Open()
        for deleted, block in open_.items():
            if block.size:
                yield block.row(next(number), deleted)

    return written(columns_of(docs, "doc_id", "text").mapInArrow(run, _BLOCK_COLUMNS))


class Block:
    """A block's tokens, and the answers that it has got so far."""

    def __init__(self, row: dict):
        self.deleted, self.doc_id, self.held_out = row["deleted"], row["doc_id"], row["held_out"]
        self.n = np.array(row["n"], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.word = unpacked(row["words"], np.uint64)[unpacked(row["tokens"], np.uint32)]
        self.train = np.repeat(np.array(row["train"], bool), self.n)
        self.counts: list[np.ndarray] = []
        self.kept: list[np.ndarray] = []
        self._often = np.zeros(0, bool)

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sorted distinct hashes of an order's n-grams, which of them each asking token has, and which tokens ask (all, if None).
        From the third order on, that takes the answers to the one before."""
        gram = self.word
        for _ in range(1, order):
            # the n-gram here is the shorter one before it and this word
            gram = self.before(gram, _START) * np.uint64(0x9E3779B97F4A7C15) + self.word
            gram ^= gram >> np.uint64(32)
            gram *= np.uint64(0xD6E8FEB86659FD93)
            gram ^= gram >> np.uint64(29)
        live = self._often & self.before(self._often, True) if order > 2 else None
        hashes, which = np.unique(gram if live is None else gram[live], return_inverse=True)
        return hashes, which.ravel(), live

    def take(self, counts: np.ndarray, gone: np.ndarray, often: np.ndarray) -> None:
        """The next order's answers, by hash."""
        _, which, live = self.asked(len(self.counts) + 1)
        if live is None:
            self.counts.append(counts[which])
            self.kept.append((counts - gone)[which])
            self._often = often[which] > 1
        else:
            # what did not ask occurs once, here
            for out, values, alone in ((self.counts, counts, self.train), (self.kept, counts - gone, self.train & (not self.deleted))):
                own = alone.astype(np.uint64)
                own[live] = values[which]
                out.append(own)
            once = np.zeros(len(live), bool)
            once[live] = often[which] > 1
            self._often = once

    def before(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each one, and ``start`` at a text's first."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def likelihoods(self, counts: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
        """By order and token: c(h w) / c(h), and c(h)'s bucket, which is 0 where the context is unknown."""
        texts = counts[0][self.first + self.n - 1].max(initial=0)
        ml, bucket = np.zeros((len(counts), len(self.word))), np.zeros((len(counts), len(self.word)), np.uint8)
        for i, c in enumerate(counts):
            context = self.before(counts[i - 1], texts).astype(float) if i else np.full(len(c), float(total))
            some = context > 0
            ml[i, some] = c[some] / context[some]
            bucket[i, some] = 1 + np.floor(np.log2(context[some])).astype(np.uint8)
        return ml, bucket


def _requests(blocks: DataFrame, answers: list[DataFrame], order: int, buckets: int) -> DataFrame:
    """What blocks ask for an order: hashes by bucket, with counts in the block."""
    known = len(answers)

    def run(batches):
        for block, number in _read(batches, known):
            hashes, which, live = block.asked(order)
            train = block.train if live is None else block.train[live]
            seen, train = (np.bincount(which, weights=w, minlength=len(hashes)).astype(np.uint64) for w in (None, train))
            cuts = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
            rows = [(i, number, block.deleted, packed(np.diff(hashes[a:b], prepend=np.uint64(0))), packed(seen[a:b]), packed(train[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
            kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "deleted", "hashes", "seen", "train"])

    return _answered(blocks, answers).mapInArrow(run, "bucket int, block long, deleted boolean, hashes binary, seen binary, train binary")


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _answers(requests: DataFrame, order: int, buckets: int) -> DataFrame:
    """For each request its n-grams' counts in all training texts, how many of these are set aside, and whether they recur; and
    a row a bucket (block null) with totals; a written table."""

    def run(batches):
        for g in groups(batches, ["bucket"]):
            deleted, own = g.column("deleted").to_numpy(zero_copy_only=False), [np.cumsum(unpacked(x, np.uint64), dtype=np.uint64) for x in g.column("hashes").to_pylist()]
            seen, train = (np.concatenate([unpacked(x, np.uint64) for x in g.column(c).to_pylist()]).astype(float) for c in ("seen", "train"))
            size = [len(x) for x in own]
            hashes, which = np.unique(np.concatenate(own), return_inverse=True)
            aside = np.where(np.repeat(deleted, size), train, 0)
            often, counts, gone = (np.bincount(which.ravel(), weights=w, minlength=len(hashes)) for w in (seen, train, aside))
            totals = {"types": int((counts > 0).sum()), "total": int(counts.sum()), "kept": int(counts.sum() - gone.sum())}
            parts = np.split(which.ravel(), np.cumsum(size)[:-1])
            made = [[packed(x[p].astype(k)) for p in parts] for x, k in ((counts, np.uint64), (gone, np.uint64), (np.minimum(often, 2), np.uint8))]
            blocks, bucket = g.column("block").to_pylist(), g.column("bucket")[0].as_py()
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*blocks, None], pa.int64()), pa.array([order] * (n + 1), pa.int32()), pa.array([bucket] * (n + 1), pa.int32()), pa.array([*deleted.tolist(), None], pa.bool_()), *[pa.array([*x, None], pa.binary()) for x in made]]
                + [pa.array([None] * n + [v], pa.int64()) for v in totals.values()],
                ["block", "kind", "bucket", "deleted", "counts", "gone", "often", *totals],
            )

    dealt = requests.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    return written(dealt.mapInArrow(run, _ANSWER_COLUMNS))


def _answered(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Blocks, each followed by its answers."""
    rows = blocks.withColumns({"kind": F.lit(0), "bucket": F.lit(0)})
    if not answers:
        return rows
    for a in answers:
        rows = rows.unionByName(a.where("block is not null").select("block", "kind", "bucket", "deleted", "counts", "gone", "often"), allowMissingColumns=True)
    partitions = max(shuffle_partitions(blocks.sparkSession), blocks.count())
    return rows.repartition(partitions, "block").sortWithinPartitions("block", "kind", "bucket")


def _read(batches, orders: int):
    """(block with the answers to so many orders, its number) of sorted rows."""
    for g in groups(batches, ["block"]):
        block, kind = Block(g.slice(0, 1).to_pylist()[0]), g.column("kind").to_numpy()
        for order in range(1, orders + 1):
            own = g.slice(int(np.searchsorted(kind, order)), int((kind == order).sum()))
            block.take(*[np.concatenate([np.zeros(0, k), *[unpacked(x, k) for x in own.column(c).to_pylist()]]) for c, k in (("counts", np.uint64), ("gone", np.uint64), ("often", np.uint8))])
        yield block, g.column("block")[0].as_py()


def mixed(ml: np.ndarray, bucket: np.ndarray, weights: np.ndarray, types: int) -> list[np.ndarray]:
    """Each token's probability by order, from 1 / (V + 1) on."""
    out = [np.full(ml.shape[1], 1 / (types + 1))]
    for m, b, w in zip(ml, bucket, weights, strict=True):
        out.append(w[b] * m + (1 - w[b]) * out[-1])
    return out


def _weights(blocks: DataFrame, answers: list[DataFrame], types: int, kept: int) -> np.ndarray:
    """Weights by order and bucket, learned on the documents set aside; a half where none tells, 0 for unknown contexts."""
    orders, weights = len(answers), np.full((len(answers), 66), 0.5)
    weights[:, 0] = 0

    def run(batches):
        for block, _ in _read(batches, orders):
            ml, bucket = block.likelihoods(block.kept, kept)
            yield pa.RecordBatch.from_arrays([pa.array([ml.astype(np.float32).tobytes()], pa.binary()), pa.array([bucket.tobytes()], pa.binary())], ["ml", "bucket"])

    aside = [a.where("deleted") for a in answers]
    seen = written(_answered(blocks.where("deleted"), aside).mapInArrow(run, "ml binary, bucket binary"))
    for _ in range(ROUNDS):
        now = weights.copy()

        def expect(batches, now=now):
            used = np.zeros((2, *now.shape))
            for b in batches:
                for m, k in zip(b.column("ml").to_pylist(), b.column("bucket").to_pylist(), strict=True):
                    bucket = np.frombuffer(k, np.uint8).reshape(orders, -1)
                    ml = np.frombuffer(m, np.float32).reshape(orders, -1)
                    p, reach = mixed(ml, bucket, now, types), np.ones(bucket.shape[1])
                    for i in range(orders - 1, -1, -1):
                        taken = reach * now[i][bucket[i]] * ml[i] / p[i + 1]
                        for at, x in enumerate((taken, reach)):
                            used[at, i] += np.bincount(bucket[i], weights=x, minlength=now.shape[1])
                        reach = reach - taken
            at = np.argwhere(used[1] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at[:, 0], pa.int32()), pa.array(at[:, 1], pa.int32()), pa.array(used[0][tuple(at.T)]), pa.array(used[1][tuple(at.T)])], ["i", "bucket", "taken", "reach"])

        # a row for each order and bucket at most
        for r in seen.mapInArrow(expect, "i int, bucket int, taken double, reach double").groupBy("i", "bucket").agg(F.sum("taken"), F.sum("reach")).collect():
            weights[r[0], r[1]] = (r[2] + 1) / (r[3] + 2)
        weights[:, 0] = 0
        if np.abs(weights - now).max() < SETTLED:
            break
    return weights


def learned(docs: DataFrame, order: int = ORDER) -> tuple[DataFrame, list[DataFrame], np.ndarray, tuple[int, int]]:
    """Blocks, their answers by order, the weights, and (training tokens, distinct ones)."""
    blocks = blocks_of(docs)
    tokens = blocks.agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-tokens // BUCKET))
    answers: list[DataFrame] = []
    for n in range(1, order + 1):
        answers.append(_answers(_requests(blocks, answers if n > 2 else [], n, buckets), n, buckets))
    types, total, kept = answers[0].where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "total", "kept")]).first()
    return blocks, answers, _weights(blocks, answers, types, kept), (total, types)


def scored(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with one added) and score, log10 of the text's
    probability, of each row."""
    blocks, answers, weights, (total, types) = learned(docs, order)

    def run(batches):
        for block, _ in _read(batches, order):
            ml, bucket = block.likelihoods(block.counts, total)
            sums = lambda x, first=block.first: np.add.reduceat(x, first)
            base = np.log10((block.counts[0] + 1.0) / (total + types + 1))
            made = [pa.array(block.doc_id, pa.int64()), pa.array(block.held_out, pa.bool_()), pa.array(block.n), pa.array(sums((block.counts[0] > 0).astype(np.int64))), pa.array(sums(base)), pa.array(sums(np.log10(mixed(ml, bucket, weights, types)[-1])))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = _answered(blocks, answers).mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
