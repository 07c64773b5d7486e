"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

A set of word shingles is hashed under PERMUTATIONS permutations, and both the minimum and the maximum under each are
kept: two values for one evaluation, each agreeing with the Jaccard similarity's probability, the pair with less
variance than two minima.  BANDS bands of ROWS values are the keys of buckets: at similarity 0.75 a pair shares no
bucket with probability 2e-5, at 0.8 with 1e-7.  In sets of up to SMALL shingles the values are too few for that; there
the set and the set without each one of its shingles are keys as well, so two small sets that link always meet.

Groups of copies never become all their pairs:
1. documents with equal sets are one class;
2. in each bucket every class is a candidate with the bucket's hub only, the class that shares most with others overall
   (of a text and its many edited copies that is the text); candidates are confirmed on their full sets;
3. links so far give components.  In buckets that hold several, each class outside the component that has most classes
   there is a candidate with one of that component's classes, picked by a hash: a few such rounds leave few buckets with
   several components, since a class has another candidate in each of its buckets;
4. what is left is compared in place: the classes of a bucket come together in blocks of bounded size, first with a byte
   of each of the 200 values, which tells who may link at all (at 0.75 about 50 differ; over DIFFER is 5 deviations more,
   probability 1e-7), then these with their texts, and only links that join components leave the task.  Buckets that hold the
   same classes are compared once, before either step.
So whatever shares a bucket is compared, and no step yields more rows than classes have buckets.  All steps are grouped
aggregates and equi-joins on buckets or classes; hot keys are split by adaptive execution, large buckets into blocks.

Defined results: null or empty texts have no shingles, are linked with nothing and kept; fewer words than a shingle are
one shingle; texts of any length are taken whole; rows that share a doc_id count as one document, so they link what each
of their texts links; a null doc_id belongs to the component that its text links it with, and to none (null) if that has
no doc_id; an empty table gives no rows; other columns take no part.  Of the rows of a component ``kept_documents``
keeps one, the one with the smallest doc_id, nulls last, also among repeated rows; rows without shingles all stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, bounded, columns_of, components, groups, written

#: Words of a shingle, link threshold in per cent, permutations, bands and values in each, most of the 200 values that may
#: differ, largest set with keys for each of its shingles.
WORDS, PERCENT, PERMUTATIONS, BANDS, ROWS, DIFFER, SMALL = 5, 75, 100, 40, 5, 81, 7
#: Rounds with hashed candidates; classes of a block by their bytes and by their texts; cells of an array in a comparison.
ROUNDS, BLOCK, TEXTS, CELLS = 3, 4096, 256, 1 << 22

_RNG = np.random.default_rng(20240101)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_ROW = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the distinct shingles, ascending. Only A-Z change case; words end at ASCII white space."""
    from xxhash import xxh3_64_intdigest

    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, split), np.uint64, len(split))
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        s += h[i : len(h) - n + 1 + i] * _PLACE[i]
    return np.unique(_mixed(s))


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side, of a set that is not empty."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for k in range(0, len(s), 1024):
        h = s[k : k + 1024, None] * _A + _B
        np.minimum(low, h.min(0), out=low)
        np.maximum(high, h.max(0), out=high)
    return np.stack([low, high], axis=1).ravel()


def band_keys(sig: np.ndarray) -> np.ndarray:
    return _mixed((_mixed(sig.reshape(BANDS, ROWS)) * _ROW).sum(1, dtype=np.uint64) + _BAND).view(np.int64)


def extra_keys(s: np.ndarray) -> np.ndarray:
    """Keys of a small set: itself, and it without each one of its shingles."""
    m = _mixed(s)
    return _mixed(m.sum(dtype=np.uint64) - np.concatenate([np.zeros(1, np.uint64), m]) + np.uint64(1)).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, two hashes of the set, its keys and a byte of each value, of each row."""

    def run(batches):
        for b in bounded(batches):
            n, h1, h2, keys, signs, ends = [], [], [], [], [], [0]
            for text in b.column("text").to_pylist():
                s = shingles(text)
                n.append(len(s))
                h1.append(int(_mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                h2.append(int((_mixed(s + np.uint64(1)) ^ s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                if len(s):
                    sig = signature(s)
                    keys += [band_keys(sig)] + ([extra_keys(s)] if len(s) <= SMALL else [])
                    signs.append((sig >> np.uint64(20) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    signs.append(b"")
                ends.append(ends[-1] + (BANDS + (len(s) + 1) * (len(s) <= SMALL)) * bool(len(s)))
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64()))
            columns = [b.column("doc_id"), b.column("th"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), bands, pa.array(signs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_shingles", "h1", "h2", "bands", "signs"])

    d = columns_of(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    return d.mapInArrow(run, "doc_id long, th long, n_shingles long, h1 long, h2 long, bands array<long>, signs binary")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. texts: id, text."""

    def run(batches):
        last, sa = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                if a != last:  # rows come by a
                    last, sa = a, shingles(ta)
                sb = shingles(tb)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(sa) + len(sb) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    t = texts.hint("merge")
    p = pairs.join(t.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").join(t.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    return p.select("a", "b", "ta", "tb").mapInArrow(lambda batches: run(bounded(batches, "tb", 1 << 21)), "a long, b long")


def in_blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows (key, id, ...) once for each two blocks p <= q of their key that their own block i is one of, sorted by them."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / size).cast("long").alias("blocks"))
    r = rows.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
    r = r.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"p": F.least("i", "with"), "q": F.greatest("i", "with")}).drop("with", "blocks")
    return r.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "id")


def sides(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the blocks p and q of a group; all rows twice where these are one block."""
    i, p, q = b.column("i").to_numpy(), b.column("p")[0].as_py(), b.column("q")[0].as_py()
    return np.flatnonzero(i == p), np.flatnonzero(i == q)


def may_link(b: pa.RecordBatch) -> np.ndarray:
    """Which rows of a group have one of another component on the other side that they may link with, by sizes and bytes."""
    comp, n = b.column("comp").to_numpy(), b.column("n").to_numpy()
    signs = np.frombuffer(b"".join(b.column("signs").to_pylist()), np.uint8).reshape(len(b), -1)
    left, right = sides(b)
    some = np.zeros(len(b), bool)
    values, counts = np.unique(comp, return_counts=True)
    usual = values[np.argmax(counts)]
    # two of the most frequent component need no look
    for x, y in ((left[comp[left] != usual], right), (left[comp[left] == usual], right[comp[right] != usual])):
        if len(y):
            step = max(1, CELLS // (len(y) * signs.shape[1]))
            for k in range(0, len(x), step):
                z = x[k : k + step]
                near = (comp[z][:, None] != comp[y]) & (100 * np.minimum(n[z][:, None], n[y]) >= PERCENT * np.maximum(n[z][:, None], n[y]))
                if near.any():
                    near &= (signs[z][:, None, :] != signs[y][None, :, :]).sum(2) <= DIFFER
                    some[z] |= near.any(1)
                    some[y] |= near.any(0)
    return some


def joining(b: pa.RecordBatch) -> list[tuple[int, int]]:
    """Links of a group, on full sets, as many as join its components."""
    ids, comp = b.column("id").to_pylist(), b.column("comp").to_pylist()
    sets = [shingles(t) for t in b.column("text").to_pylist()]
    sizes = np.array(list(map(len, sets)))
    shared, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times[column] > 1
    row, column = np.repeat(np.arange(len(sets)), sizes)[some], (np.cumsum(times > 1) - 1)[column[some]]
    wide = int((times > 1).sum())
    both, step = np.zeros((len(sets), len(sets)), np.float32), max(1, min(wide, CELLS // len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for k in range(0, wide, step):
        part = slice(*np.searchsorted(column, [k, k + step]))
        m = np.zeros((len(sets), step), np.float32)
        m[row[part], column[part] - k] = 1
        both += m @ m.T
    near = 100 * both >= PERCENT * (sizes[:, None] + sizes - both)
    left, right = sides(b)
    up = {c: c for c in comp}

    def root(c):
        while up[c] != c:
            up[c] = c = up[up[c]]
        return c

    out = []
    for x, y in zip(*np.nonzero(near[np.ix_(left, right)]), strict=True):
        i, j = left[x], right[y]
        a, c = root(comp[i]), root(comp[j])
        if a != c:
            up[max(a, c)] = min(a, c)
            out.append((ids[i], ids[j]))
    return out


def once(rows: DataFrame) -> DataFrame:
    """rows (key, id, comp) without the keys that hold the same ids as a smaller one: their pairs are compared there."""
    held = [F.bit_xor(F.xxhash64("id", F.lit(i))) for i in (0, 1)]
    same = rows.groupBy("key").agg(F.count("*").alias("n"), held[0].alias("x"), held[1].alias("y")).groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    return rows.join(same.select("key"), "key", "left_semi")


def compared(mixed: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join components of the same bucket. mixed: key, id, comp."""

    def active(batches):
        for g in groups(batches, ["key", "p", "q"]):
            yield g.select(["key", "id", "comp"]).filter(pa.array(may_link(g), pa.bool_()))

    def exact(batches):
        for g in groups(batches, ["key", "p", "q"]):
            if found := joining(g):
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    by_bytes = in_blocks(once(mixed).join(classes.select("id", "n", "signs").hint("merge"), "id"), BLOCK)
    some = written(by_bytes.select("key", "p", "q", "i", "id", "comp", "n", "signs").mapInArrow(active, "key long, id long, comp long").distinct())
    return in_blocks(once(some).join(texts.hint("merge"), "id"), TEXTS).select("key", "p", "q", "i", "id", "comp", "text").mapInArrow(exact, "a long, b long").distinct()


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Confirmed pairs (a, b) that connect what is connected. classes: id, doc_id and th of one of its rows, n, bands, signs."""
    keyed = classes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keyed.join(shared, "key"))
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    hubs = members.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("h")).select("key", (-F.col("h.minus")).alias("hub"))
    tested = written(members.join(hubs, "key").where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct())
    of = classes.join(weight, "id", "left_semi").select("id", F.col("doc_id").alias("_d"), F.col("th").alias("_t"))
    texts = columns_of(docs, "doc_id", "text").withColumn("th", F.xxhash64("text"))
    texts = texts.join(of, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("id", "text")
    texts = written(texts.groupBy("id").agg(F.first("text").alias("text")))
    found = written(confirmed(tested, texts))
    for turn in range(ROUNDS + 1):
        at = components(found)
        placed = members.join(at, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
        each = placed.groupBy("key", "comp").agg(F.count("*").alias("n"), F.min_by("id", F.xxhash64("id", "key", F.lit(turn))).alias("hub"))
        main = each.groupBy("key").agg(F.max(F.struct("n", "comp", "hub")).alias("m"), F.count("*").alias("comps")).where("comps > 1")
        if turn == ROUNDS:
            break
        pairs = placed.join(main.select("key", F.col("m.comp").alias("_comp"), F.col("m.hub").alias("hub")), "key").where("comp <> _comp")
        pairs = pairs.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        both = tested.union(tested.select("b", "a"))
        pairs = written(pairs.join(both, ["a", "b"], "left_anti"))
        more = written(confirmed(pairs, texts))
        tested, found = tested.union(pairs), found.union(more)
        if more.limit(1).count() == 0:
            break
    mixed = written(placed.join(main.select("key"), "key", "left_semi"))
    return found.union(compared(mixed, classes, texts))


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, th, n_shingles, and of rows with shingles their component and the smallest doc_id there, of each row."""
    rows = written(sketches(docs))
    some = rows.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f")
    classes = some.groupBy("h1", "h2").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("signs").alias("signs"))
    # numbers of rows of a written table stay
    classes = written(classes.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", "f.doc_id", "f.th", "n", "bands", "signs"))
    found = links(docs, classes)
    # rows that share a doc_id but not their text tie their classes together
    again = some.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    several = some.join(again, "doc_id", "left_semi").join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select("doc_id", "id").distinct()
    ties = several.join(several.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b")).where("a <> b")
    at = components(found.union(ties)).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    placed = classes.join(at, F.col("id") == F.col("_node"), "left").select("h1", "h2", "doc_id", F.coalesce("_component", "id").alias("component"))
    least = placed.groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("least"))
    placed = placed.drop("doc_id").join(least, F.col("component") == F.col("_c")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component", "least")
    same = (F.col("n_shingles") > 0) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return rows.select("doc_id", "th", "n_shingles", "h1", "h2").join(placed, same, "left").select("doc_id", "th", "n_shingles", "component", "least")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    out = _placed(docs).select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each component, with its columns as they were, and all rows without shingles."""
    placed = _placed(docs).where("component is not null")
    one = placed.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("f"), F.count("*").alias("c"))
    times = placed.groupBy(F.col("component").alias("_c"), F.col("doc_id").alias("_d"), F.col("th").alias("_t")).agg(F.count("*").alias("times"))
    one = written(one.join(times, (F.col("component") == F.col("_c")) & F.col("f.doc_id").eqNullSafe(F.col("_d")) & (F.col("f.th") == F.col("_t"))).select("_d", "_t", "times"))
    d = docs.withColumn("_th", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))
    single = d.join(one.where("times = 1"), same, "left_semi").drop("_th")
    repeated = d.join(one.where("times > 1"), same, "left_semi").dropDuplicates(["doc_id", "_th"]).drop("_th")
    empty = docs.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return single.unionByName(repeated).unionByName(empty)
