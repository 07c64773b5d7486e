"""Exact top-k inner products: norm-sorted vectors, SVD-rotated partial sums, Cauchy-Schwarz residual bounds.

A rotation that puts the vectors' energy first comes from the eigenvectors of their second-moment matrix, which is
summed over all rows (width x width numbers, whatever the number of rows).  Candidates are parted by length into a few
strata and these into blocks of bounded size.  All queries first meet the stratum of the longest vectors, which gives each
a k-th score; then they go only to the strata whose longest vector could still beat it.  In a block the candidates go by
descending length, in slices.  A query leaves when its length times the length of the slice's first candidate can't reach
its k-th score so far; for the rest the product of the leading rotated components plus the product of the lengths of what
remains bounds the score from above, and only pairs whose bound reaches the k-th score get the exact product.  Bounds are
widened by more than the rounding of doubles.  Scores below 2**53 are exact as sums of whole numbers in doubles; where
vectors are so long that scores may be larger, products are made of Python's integers.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do null vec_ids; shorter
vectors count as padded with zeros; empty vectors score 0; ties go to the smaller vec_id; rows that share a vec_id are
candidates each, but none for a query of that id, and of those that share a query's id the smallest vector asks; with
fewer than k candidates all are returned; scores beyond a long's range are ranked exactly and returned as its limit; an
empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, written

#: Queries of a block and those compared at once, candidates of a block and a slice, share of components in partial sums,
#: strata of length.
QUERY_BLOCK, AT_ONCE, BLOCK, SLICE, LEAD, STRATA = 32768, 2048, 16384, 1024, 0.5, 4


def scaled(vectors: DataFrame, factor: int) -> DataFrame:
    """vec_id and v: the whole numbers floor(factor * x), of vectors that take part."""
    v = columns_of(vectors, "vec_id", "embedding").where("vec_id is not null and embedding is not null")
    v = v.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))))
    return v.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * float(factor)).cast("double")).alias("v"))


def matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of numbers, padded with zeros."""
    if len(column) and all(len(v) == width for v in column):
        return np.stack(column.to_numpy()).astype(np.float64)
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Right singular vectors of all rows, by descending singular value."""

    def moments(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b["v"], width)
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    summed = vectors.select("v").mapInPandas(moments, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    m = np.zeros((width, width))
    for i, j, x in summed.collect():  # width * width numbers
        m[i, j] = x
    return np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()


def best_of(q_ids, q, floor, c_ids, c, turn, k, lead, wide=False):
    """For each query its k best candidates that score ``floor`` at least, as (query ids, candidate ids, scores).

    wide: scores may not fit doubles, so they are Python's integers.
    """
    length = np.linalg.norm(c, axis=1)
    order = np.lexsort((c_ids, -length))
    c_ids, c, length = c_ids[order], c[order], length[order]
    q_length = np.linalg.norm(q, axis=1)
    q_turned, c_turned = q @ turn, c @ turn
    q_rest, c_rest = np.linalg.norm(q_turned[:, lead:], axis=1), np.linalg.norm(c_turned[:, lead:], axis=1)
    slack = 1e-9 * (1 + q_length * length.max(initial=0))
    whole = (lambda x: np.array([[int(z) for z in r] for r in x], object).reshape(x.shape)) if wide else (lambda x: x)
    q_whole, c_whole, least = whole(q), whole(c), -(1 << 4096) if wide else -np.inf
    floor = floor.copy()
    scores, who = np.full((len(q), k), least, object if wide else float), np.full((len(q), k), -1, np.int64)
    for s in range(0, len(c), SLICE):
        live = np.flatnonzero(~(q_length * length[s] + slack < floor))
        if not len(live):
            break
        part = slice(s, s + SLICE)
        bound = q_turned[live, :lead] @ c_turned[part, :lead].T + q_rest[live, None] * c_rest[None, part] + slack[live, None]
        open_ = ~(bound < floor[live, None])
        live_rows = np.flatnonzero(open_.any(1))
        if not len(live_rows):
            continue
        columns = np.flatnonzero(open_.any(0))
        rows = live[live_rows]
        exact = q_whole[rows] @ c_whole[part][columns].T
        exact[~open_[np.ix_(live_rows, columns)] | (q_ids[rows, None] == c_ids[part][columns][None, :])] = least
        all_scores = np.concatenate([scores[rows], exact], axis=1)
        all_who = np.concatenate([who[rows], np.broadcast_to(columns + s, exact.shape)], axis=1)
        ids = np.where(all_who >= 0, c_ids[all_who], np.iinfo(np.int64).max)
        kth = -np.partition(-all_scores, k - 1, axis=1)[:, k - 1]
        for i, r in enumerate(rows):
            fit = np.flatnonzero(all_scores[i] >= kth[i])
            fit = fit[np.lexsort((ids[i, fit], -all_scores[i, fit]))[:k]] if not wide else np.array(sorted(fit, key=lambda j: (-all_scores[i, j], ids[i, j]))[:k])
            scores[r, : len(fit)], who[r, : len(fit)] = all_scores[i, fit], all_who[i, fit]
        kth = scores[rows, k - 1]
        # doubles round large integers: a floor may only be too low
        floor[rows] = np.maximum(floor[rows], np.array([float(x) * (1 - 1e-12 * (1 if x > 0 else -1)) if x > least else -np.inf for x in kth]) if wide else kth)
    a, b = np.nonzero(scores > least)
    return q_ids[a], c_ids[who[a, b]], scores[a, b]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest whole-number inner products with other rows."""
    v = scaled(vectors, factor).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    v = written(v)
    rows, asked, width, longest = v.agg(F.count("*"), F.count_distinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id"))), F.max(F.size("v")), F.max("length")).first()
    if not rows or not asked:
        return v.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, wide = max(1, width), not longest < 2.0**26.5
    turn, lead = rotation(v, width), max(1, int(width * LEAD))
    # bounds of strata by length, the longest first; equal lengths are one stratum
    cuts = sorted({*v.approxQuantile("length", [i / STRATA for i in range(1, STRATA)], 0.01)}, reverse=True) if rows > BLOCK else []
    of = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        of = F.when(F.col("length") > cuts[i], i).otherwise(of)
    v = v.withColumn("stratum", of)
    strata = v.groupBy("stratum").agg(F.count("*").alias("n"), F.max("length").alias("longest")).orderBy("stratum").collect()
    q_blocks = -(-asked // QUERY_BLOCK)
    # a number for each distinct value: its least vector asks
    ask = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "length")).alias("m")).select("vec_id", "m.v", "m.length")
    ask = written(ask.withColumn("qb", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(q_blocks)).cast("int")))

    def run(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        ids, m = c["vec_id"].to_numpy(), matrix(c["v"], width)
        out = []
        for first in range(0, len(q), AT_ONCE) if len(c) else ():
            x = q.iloc[first : first + AT_ONCE]
            a, b, s = best_of(x["vec_id"].to_numpy(), matrix(x["v"], width), x["floor"].to_numpy(), ids, m, turn, k, lead, wide)
            out.append(pd.DataFrame({"query_id": a, "vec_id": b, "score": [str(z) for z in s] if wide else s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    found, kind = None, "string" if wide else "double"
    best = Window.partitionBy("query_id").orderBy(*([F.desc("digits"), F.desc("ordered")] if wide else [F.desc("score")]), "vec_id")

    def ranked(hits: DataFrame) -> DataFrame:
        if wide:  # longer numbers are larger, those of a length go by their digits; below zero the other way round
            size, below = F.length("score"), F.col("score").startswith("-")
            hits = hits.withColumn("digits", F.when(below, -size).otherwise(size)).withColumn("ordered", F.when(below, F.translate("score", "0123456789", "9876543210")).otherwise(F.col("score")))
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    for s in strata:
        if found is None:
            going = ask.withColumn("floor", F.lit(float("-inf")))
        else:
            kth = found.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").cast("double").alias("_s"))
            # a little below what is reached, so that rounding drops no tie
            going = ask.join(kth, F.col("vec_id") == F.col("_q"), "left").withColumn("floor", F.coalesce(F.col("_s") - F.abs("_s") * 1e-9 - 1, F.lit(float("-inf")))).drop("_q", "_s")
            going = going.where(~(F.col("length") * s.longest * (1 + 1e-9) + 1 < F.col("floor")))
        blocks = max(4, -(-s.n // BLOCK))
        each = going.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        have = v.where(F.col("stratum") == s.stratum).select("vec_id", "v", F.pmod(F.xxhash64(F.lit(2), "vec_id", "v"), F.lit(blocks)).cast("int").alias("cb"))
        have = have.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        hits = each.groupBy("qb", "cb").cogroup(have.groupBy("qb", "cb")).applyInPandas(run, f"query_id long, vec_id long, score {kind}")
        found = written(ranked(hits if found is None else found.select("query_id", "vec_id", "score").union(hits)))
    return found.withColumn("score", F.when(F.col("score").cast("decimal(38,0)").isNull() | (F.abs(F.col("score").cast("double")) >= 2.0**63), F.when(F.col("score").startswith("-"), -(2**63)).otherwise(2**63 - 1)).otherwise(F.col("score").cast("decimal(38,0)").cast("long")) if wide else F.col("score").cast("long"))
