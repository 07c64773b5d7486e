"""Near-duplicate embeddings by NN-descent: a neighbour graph refined by neighbours-of-neighbours joins.

1. Vectors are normalised in double precision.  Equal vectors are one class, represented by the smallest vec_id.
2. The first graph comes from random-hyperplane tables.  Buckets hold some vectors on average whatever the number of
   rows, so a pair is parted more often the more rows there are: the number of tables grows such that a pair at THRESHOLD
   meets in none of them with probability MISS at most.  All that share a bucket are compared; large buckets in blocks.
3. In each round every vector brings its neighbours and those that have it as a neighbour together: all that meet are
   compared in numpy, and pairs that beat the weakest entry of a list enter it.
4. A list whose LIST entries are all links is saturated and is enlarged, to WIDE entries that are links.  Links are not cut
   beyond that either: whatever is compared in steps 2 and 3 gives, beside list entries, a forest that spans its links.  So
   a list whose true list is longer than any fixed length loses no tie to another group.  Counts of links come from
   comparing whole components in blocks of bounded size.
5. An audit takes vectors picked by a hash, compares them with all rows, and measures which share of their true links the
   components hold, over all that have links and over those with few; each vector weighs the same.  It takes more until
   SEEN vectors with few links were met, all rows taken, or VALUES reached.  Below GOAL more tables and rounds follow,
   after ATTEMPTS a comparison of all rows in blocks.
Components come from links by grouped minima and joins (see common.components).

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept;
vectors of different lengths never link; rows that share a vec_id count as one node, which has the least of their vectors;
a null vec_id links with nothing; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, components, written

#: Cosine of a link; entries of a list, and of a saturated one; tables that give list entries; entries from a bucket; vectors in a bucket.
THRESHOLD, LIST, WIDE, TABLES, BESIDE, BUCKET = 0.95, 10, 16, 6, 4, 16
#: Largest part of a bucket, rounds of refinement, vectors audited, recall to reach, most enlargements, vectors in a block.
PART, ROUNDS, AUDITED, GOAL, ATTEMPTS, BLOCK = 1024, 2, 200, 0.98, 4, 1024
#: Most that tables may miss at THRESHOLD; vectors with few links that an audit needs; most numbers in its sample.
MISS, SEEN, VALUES = 0.01, 50, 1_000_000
#: What rounding to single precision changes in a cosine, at most; kinds of rows that comparisons yield.
ROUNDED, ENTRY, LINK, DOUBTFUL = 2e-7, 0, 1, 2


def prepared(vectors: DataFrame) -> DataFrame:
    """vec_id and v, of unit length, for the vectors that can link."""

    def run(batches):
        for b in batches:
            column = b.column("embedding")
            widths, values = np.diff(column.offsets.to_numpy()), column.flatten()
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            # nulls have become NaN; the first component of each vector tells where it is
            first = column.offsets.to_numpy()[:-1] - column.offsets.to_numpy()[0]
            for w in np.unique(widths):
                rows = np.flatnonzero(widths == w)
                m = x[first[rows][:, None] + np.arange(w)]
                # the largest component first, so that neither squares overflow nor small vectors vanish
                top = np.abs(m).max(1)
                some = np.isfinite(m).all(1) & (top > 0)
                m = m[some] / top[some, None]
                m /= np.sqrt((m * m).sum(1))[:, None]
                v = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * w, pa.int32()), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows[some])), v], ["vec_id", "v"])

    v = columns_of(vectors, "vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    return v.mapInArrow(run, "vec_id long, v array<double>")


def _rows(column) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def planned(rows: int) -> tuple[int, int]:
    """Hyperplanes of a table and the number of tables for so many rows."""
    bits = max(1, int(np.log2(max(2, rows / BUCKET))))
    meet = (1 - np.arccos(THRESHOLD) / np.pi) ** bits
    return bits, max(TABLES, int(np.ceil(np.log(MISS) / np.log(1 - meet))))


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (p, q) of edges that join what the symmetric matrix joins: all of its pairs if they are few."""
    p, q = np.nonzero(np.triu(near, 1))
    if len(p) <= 2 * len(near):
        return p, q
    roots, leaves, pending = [], [], near.any(1)
    while pending.any():
        root = int(np.argmax(pending))
        seen = np.zeros(len(near), bool)
        seen[root], front = True, np.array([root])
        while len(front):
            new = near[front].any(0) & ~seen
            seen |= new
            front = np.flatnonzero(new)
        pending &= ~seen
        seen[root] = False
        leaves.append(np.flatnonzero(seen))
        roots.append(np.full(len(leaves[-1]), root))
    return np.concatenate(roots), np.concatenate(leaves)


def compared(ids: np.ndarray, v: np.ndarray, i: np.ndarray, p: int, q: int, entries: bool):
    """(a, b, s, kind) of one bucket, or of its blocks p and q: BESIDE best of each vector, links, pairs too close to say."""
    left, right = (np.flatnonzero(i == p), np.flatnonzero(i == q)) if p != q else (slice(None), slice(None))
    s = np.full((len(ids), len(ids)), -2.0)
    if p == q:
        s = v @ v.T
        np.fill_diagonal(s, -2.0)
    else:
        s[np.ix_(left, right)] = v[left] @ v[right].T
        s = np.maximum(s, s.T)
    out = []
    if s.max(initial=-2.0) >= THRESHOLD - ROUNDED:
        sure = s >= THRESHOLD + ROUNDED
        out += [(*forest(sure), LINK), (*np.nonzero(np.triu((s >= THRESHOLD - ROUNDED) & ~sure, 1)), DOUBTFUL)]
    if entries and p == q:
        best = np.ones(s.shape, bool)
        if len(ids) > BESIDE + 1:
            best[:] = False
            np.put_along_axis(best, np.argpartition(s, -BESIDE, axis=1)[:, -BESIDE:], True, axis=1)
        out.append((*np.nonzero(np.triu(best | best.T, 1)), ENTRY))
    return [(np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), s[x, y], np.full(len(x), kind, np.int32)) for x, y, kind in out if len(x)]


def tables(classes: DataFrame, bits: int, number: int, attempt: int) -> DataFrame:
    """(a, b, s, kind) from comparing all that share a bucket of random hyperplanes; bits = 0: all with all.

    classes: id, v.
    """

    def keyed(carry: bool):
        def run(batches):
            planes: dict[int, np.ndarray] = {}
            weights = (1 << np.arange(bits)).astype(np.int64)
            for b in batches:
                widths = np.diff(b.column("v").offsets.to_numpy())
                for width in np.unique(widths):
                    part = b.filter(pa.array(widths == width))
                    if width not in planes:
                        planes[width] = np.random.default_rng([attempt, int(width)]).standard_normal((int(width), number * bits))
                    keys = (((_rows(part.column("v")) @ planes[width]).reshape(len(part), number, bits)) > 0) @ weights
                    v = part.column("v").cast(pa.list_(pa.float32())) if carry else None
                    for t in range(number):
                        own = [pa.array(np.full(len(part), t, np.int32)), pa.array(np.full(len(part), width, np.int32)), pa.array(keys[:, t].astype(np.int64))]
                        yield pa.RecordBatch.from_arrays([part.column("id"), *own, *([v] if carry else [])], ["id", "t", "w", "key", *(["v"] if carry else [])])

        return classes.select("id", "v").mapInArrow(run, "id long, t int, w int, key long" + ", v array<float>" * carry)

    def run(batches):
        rest = None
        for b in batches:
            b = b if rest is None else pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            marks = np.stack([b.column(c).to_numpy().astype(np.int64) for c in ("t", "w", "key", "p", "q")])
            starts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            last = int(starts[-1]) if len(starts) else 0
            yield from found(b.slice(0, last), np.concatenate([[0], starts]).tolist(), marks)
            rest = b.slice(last)
        if rest is not None:
            yield from found(rest, [0, len(rest)], np.stack([rest.column(c).to_numpy().astype(np.int64) for c in ("t", "w", "key", "p", "q")]))

    def found(b, starts, marks):
        if not len(b):
            return
        ids, i, flat, offsets = b.column("id").to_numpy(), b.column("i").to_numpy(), b.column("v").flatten().to_numpy(), b.column("v").offsets.to_numpy()
        out = []
        for x, y in zip(starts[:-1], starts[1:], strict=True):
            if y - x > 1:
                t, w, _, p, q = marks[:, x].tolist()
                at = int(offsets[x] - offsets[0])
                out += compared(ids[x:y], flat[at : at + w * (y - x)].reshape(-1, w).astype(float), i[x:y], p, q, bits > 0 and t < TABLES)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "s", "kind"])

    key = ["t", "w", "key"]
    large = written(keyed(False).groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > PART).withColumn("blocks", F.ceil(F.col("n") / PART).cast("long")).drop("n"))
    k = keyed(True).join(large, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)).cast("long")).withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
    k = k.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)"))).select(*key, F.least("i", "with").alias("p"), F.greatest("i", "with").alias("q"), "i", "id", "v")
    return k.repartition(*key, "p", "q").sortWithinPartitions(*key, "p", "q").mapInArrow(run, "a long, b long, s double, kind int")


def similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, s): pairs with their cosine."""
    va, vb = classes.select(F.col("id").alias("a"), F.col("v").alias("va")), classes.select(F.col("id").alias("b"), F.col("v").alias("vb"))

    def run(batches):
        for b in batches:
            x, y = b.column("va"), b.column("vb")
            same = x.offsets.to_numpy()[1:] - x.offsets.to_numpy()[:-1] == y.offsets.to_numpy()[1:] - y.offsets.to_numpy()[:-1]
            s = np.array([float(np.dot(p, q)) if ok else -1.0 for p, q, ok in zip(x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False), same, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], ["a", "b", "s"])

    return pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb").mapInArrow(run, "a long, b long, s double")


def lists(edges: DataFrame) -> DataFrame:
    """The LIST best of both directions of (a, b, s) for each a, and if these are links, links up to the WIDE best."""
    both = edges.union(edges.select("b", "a", "s"))
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    return both.groupBy("a", "b").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(best)).where((F.col("r") <= WIDE) & ((F.col("r") <= LIST) | (F.col("s") >= THRESHOLD))).drop("r")


def refined(graph: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, s, kind) from one neighbours-of-neighbours join over lists (a, b, s): new entries, and links that lists may cut."""
    weakest = graph.groupBy("a").agg(F.min("s").alias("low"), F.count("*").alias("n"))
    # an open list takes anything, a saturated one that has room takes links
    weakest = weakest.select(F.col("a").alias("id"), F.when(F.col("n") < LIST, -2.0).when((F.col("n") < WIDE) & (F.col("low") >= THRESHOLD), THRESHOLD - ROUNDED).otherwise(F.col("low")).alias("low"))
    carried = classes.select("id", "v").join(weakest, "id")
    # a meets its own list and those that list it; the latter are parted where many do, so no meeting is unbounded
    meet = graph.select(F.col("a").alias("at"), F.col("b").alias("id"), F.lit(0).alias("part"))
    back = graph.select(F.col("b").alias("at"), F.col("a").alias("id"))
    many = back.groupBy("at").agg(F.ceil(F.count("*") / (2 * LIST)).cast("int").alias("parts"))
    back = back.join(many, "at").select("at", "id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))
    own = graph.select(F.col("a").alias("at"), F.col("a").alias("id"), F.lit(0).alias("part"))
    met = meet.union(back).union(own).distinct().join(carried, "id")

    def run(batches):
        for batch in batches:
            x, ends = batch.column("ids").flatten().to_numpy(), batch.column("ids").offsets.to_numpy()
            low, vectors = batch.column("lows").flatten().to_numpy(), batch.column("vs").flatten()
            widths = np.diff(vectors.offsets.to_numpy())
            first, values = vectors.offsets.to_numpy()[:-1] - vectors.offsets.to_numpy()[0], vectors.flatten().to_numpy()
            out = []
            for begin, end in zip((ends[:-1] - ends[0]).tolist(), (ends[1:] - ends[0]).tolist(), strict=True):
                for w in {*widths[begin:end].tolist()}:
                    i = begin + np.flatnonzero(widths[begin:end] == w)
                    m = values[first[i[0]] : first[i[0]] + w * len(i)].reshape(-1, w) if len(i) == end - begin else np.stack([values[f : f + w] for f in first[i]])
                    s = m @ m.T
                    p, q = np.nonzero(np.triu(s > np.minimum(low[i][:, None], low[i][None, :]), 1))
                    near = s >= THRESHOLD
                    np.fill_diagonal(near, False)
                    for (p, q), kind in (((p, q), ENTRY), (forest(near), LINK)):
                        a, b = x[i[p]], x[i[q]]
                        out.append((np.minimum(a, b), np.maximum(a, b), s[p, q], np.full(len(p), kind, np.int32)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "s", "kind"])

    groups = met.groupBy("at", "part").agg(F.collect_list(F.struct("id", "low", "v")).alias("m")).select(F.col("m.id").alias("ids"), F.col("m.low").alias("lows"), F.col("m.v").alias("vs"))
    return groups.mapInArrow(run, "a long, b long, s double, kind int").groupBy("a", "b", "kind").agg(F.max("s").alias("s"))


def counted(classes: DataFrame, at: DataFrame) -> DataFrame:
    """(id, n): links of each class inside its component, by blocks of bounded size, each link weighing its copies.

    classes: id, v, copies; at: node, component.
    """
    m = written(classes.join(at, classes.id == at.node).select("component", "id", "copies", "v"))
    blocks = m.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    m = m.join(blocks, "component").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")))
    m = m.withColumn("with", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("component", F.least("i", "with").alias("p"), F.greatest("i", "with").alias("q"), "i", "id", "copies", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, p, q = pdf["i"].to_numpy(), pdf["p"].iloc[0], pdf["q"].iloc[0]
        ids, copies = pdf["id"].to_numpy(), pdf["copies"].to_numpy()
        n, width = np.zeros(len(pdf), np.int64), pdf["v"].map(len).to_numpy()
        left, right = np.flatnonzero(i == p), np.flatnonzero(i == q)
        for w in np.unique(width):
            l, r = left[width[left] == w], right[width[right] == w]
            if len(l) and len(r):
                near = np.stack(pdf["v"].to_numpy()[l]) @ np.stack(pdf["v"].to_numpy()[r]).T >= THRESHOLD
                near &= ids[l][:, None] != ids[r][None, :]
                n[l] += near @ copies[r]
                if p != q:
                    n[r] += copies[l] @ near
        return pd.DataFrame({"id": ids, "n": n})

    return m.groupBy("component", "p", "q").applyInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def audit(classes: DataFrame, at: DataFrame, rows: int) -> tuple[float, int]:
    """Share of true links that lie inside components, and how many vectors with few links it rests on.

    The mean over sampled vectors with links or over those with at most LIST links, whichever is lower.
    """
    placed = classes.join(at, classes.id == at.node, "left").select("id", "v", F.coalesce("component", "id").alias("c"))
    most = max(AUDITED, VALUES // max(1, classes.agg(F.max(F.size("v"))).first()[0]))
    size = AUDITED
    while True:
        share, few = measured(placed, min(size, most))
        if few >= SEEN or size >= min(rows, most):
            return share, few
        size *= 8


def measured(placed: DataFrame, size: int) -> tuple[float, int]:
    """audit() by one sample of bounded size. placed: id, v, c."""
    sample = placed.orderBy(F.xxhash64(F.lit("audit"), "id"), "id").limit(size).toArrow().combine_chunks()
    widths = np.array([len(x) for x in sample.column("v")])
    have = {}
    for w in np.unique(widths).tolist():
        own = sample.filter(pa.array(widths == w))
        have[w] = (np.array(own.column("v").to_pylist()), own.column("id").to_numpy(), own.column("c").to_numpy())

    def run(batches):
        for b in batches:
            widths = np.diff(b.column("v").offsets.to_numpy())
            for w, (x, ids, c) in have.items():
                part = b.filter(pa.array(widths == w))
                if not len(part):
                    continue
                m, mine, theirs = _rows(part.column("v")), part.column("id").to_numpy(), part.column("c").to_numpy()
                for first in range(0, len(x), 512):
                    of = slice(first, first + 512)
                    near = (m @ x[of].T >= THRESHOLD) & (mine[:, None] != ids[of][None, :])
                    true, held = near.sum(0), (near & (theirs[:, None] == c[of][None, :])).sum(0)
                    some = np.flatnonzero(true)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[of][some]), pa.array(true[some].astype(np.int64)), pa.array(held[some].astype(np.int64))], ["id", "true", "held"])

    each = placed.mapInArrow(run, "id long, true long, held long").groupBy("id").agg(F.sum("true").alias("true"), F.sum("held").alias("held"))
    few = F.col("true") <= LIST
    r = each.agg(F.avg(F.col("held") / F.col("true")), F.avg(F.when(few, F.col("held") / F.col("true"))), F.count(F.when(few, 1))).first()
    return min(1.0 if x is None else x for x in r[:2]), r[2]


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    all_rows = columns_of(vectors, "vec_id")
    v = written(prepared(vectors).groupBy("vec_id").agg(F.min("v").alias("v")))
    classes = written(v.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    rows = classes.count()
    graph = links = at = None
    if rows:
        for attempt in range(ATTEMPTS + 1):
            whole = attempt == ATTEMPTS
            fresh = written(tables(classes, *((0, 1) if whole else planned(rows)), attempt))
            entries, sure = fresh.where(F.col("kind") == ENTRY).select("a", "b", "s"), fresh.where(F.col("kind") == LINK).select("a", "b")
            doubtful = similar(fresh.where(F.col("kind") == DOUBTFUL).select("a", "b").distinct(), classes).where(F.col("s") >= THRESHOLD).select("a", "b")
            new = sure.union(doubtful)
            if not whole:
                graph = written(lists(entries if graph is None else entries.union(graph)))
                for _ in range(ROUNDS):
                    fresh = written(refined(graph, classes))
                    new = new.union(fresh.where(F.col("kind") == LINK).select("a", "b"))
                    graph = written(lists(graph.union(fresh.where(F.col("kind") == ENTRY).select("a", "b", "s"))))
            links = written((new if links is None else new.union(links)).distinct())
            at = components(links)
            if whole or audit(classes, at, rows)[0] >= GOAL:
                break
        n = counted(classes, at)
        found = classes.join(n, "id", "left").join(at, F.col("id") == F.col("node"), "left")
        found = found.select("v", F.coalesce("n", F.lit(0)).alias("_n"), "copies", F.coalesce("component", "id").alias("_c"))
        found = v.join(found, "v").select(F.col("vec_id").alias("_id"), (F.col("_n") + F.col("copies") - 1).alias("_links"), "_c")
    else:
        found = v.select(F.col("vec_id").alias("_id"), F.lit(0).cast("long").alias("_links"), F.col("vec_id").alias("_c"))
    out = all_rows.join(found, F.col("vec_id") == F.col("_id"), "left")
    out = out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("_c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
