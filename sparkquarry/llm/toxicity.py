"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al. 2017), in numpy.

Confirmed toxic documents are positives; documents at large, labelled or not, are unlabelled.  A linear model minimises
pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)]) with the logistic loss l and the class prior pi; where the second
part falls below zero the step goes against it, which keeps a flexible model from overfitting to the positives.  The
prior is the share of toxic rows among the labels that may be learned from.

Features are the distinct words of a text, lower-cased and without outer punctuation, and their beginnings of three to
six letters, hashed; the few thousand that set positives apart most (by a two-proportion z) are used, as logarithms of
counts.  Fitting takes at most POSITIVES and UNLABELLED documents, picked by a hash of doc_id, one text each; everything
else covers all rows: each text is scored whole, by one pass in Arrow batches.  The executors count the sample's features
and choose the model's; what the driver fits is a row of at most FEATURES + 1 numbers for each text of the sample,
whatever its length.  The model is a table of at most FEATURES numbers.

Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0, and labels, lang, source and doc_id are no inputs
of a score.  Defined results: null and empty texts get the score of a text without features; texts of any length are
scored whole; with no confirmed toxic document to learn from each score is 0; rows that share a doc_id are scored each by
its own text, and the least of their texts is learned from; of labels that share a doc_id one that says toxic counts; a
null doc_id is not held out and not learned from; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_of, written

#: Bounds of the fitting sample and of the model; fold that is not learned from; words that a worker remembers, their letters.
POSITIVES, UNLABELLED, FEATURES, FOLDS, REMEMBERED, LONGEST = 3000, 6000, 1024, 5, 200_000, 64
#: Bits of a feature hash; the z from which a feature is used: chance reaches it in few of some 100,000 features.
BITS, SURE = 22, 4.5
_OUTER = ".,;:!?\"'()[]{}<>*_-–—…«»„“”‘’"


def features_of(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    w = word.strip(_OUTER)
    if not w:
        return []
    raw = [f"={w}"] + [w[:n] for n in range(3, 7) if len(w) >= n]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for x in raw]


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def folds(df: DataFrame) -> DataFrame:
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)))


def _counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's features, ascending, and how many of its distinct words have each."""
    return np.unique(np.array([f for w in words_of(text) for f in features_of(w)], np.int32), return_counts=True)


def _chosen(sample: DataFrame, pos: int, unl: int) -> np.ndarray:
    """The features that set positives apart most, in either direction, ascending: at most FEATURES, found by the executors.

    sample: toxic (whether the row stands for a positive) and text.
    """

    def run(batches):
        for b in bounded(batches):
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            own = [_counted(t)[0] for t in b.column("text").to_pylist()]
            ids, at = np.unique(np.concatenate([np.zeros(0, np.int32), *own]), return_inverse=True)
            of = np.repeat(toxic, [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids)] + [pa.array(np.bincount(at, weights=w, minlength=len(ids)).astype(np.int64)) for w in (of, ~of)], ["feature", "p", "u"])

    c = sample.mapInArrow(run, "feature int, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where("p + u >= 5")
    share = (F.col("p") + F.col("u")) / (pos + unl)
    z = F.abs((F.col("p") / pos - F.col("u") / unl) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / pos + 1 / unl)))
    best = c.withColumn("z", z).where(F.col("z") > SURE).orderBy(F.desc("z"), "feature").limit(FEATURES)
    return np.array(sorted(r[0] for r in best.select("feature").collect()), np.int32)


def _dense(sample: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positives and unlabelled texts as rows of FEATURES + 1 numbers at most, whatever the texts' length."""
    width = len(chosen) + 1

    def run(batches):
        for b in bounded(batches):
            rows = np.zeros((len(b), width), np.float32)
            rows[:, -1] = 1
            for row, text in zip(rows, b.column("text").to_pylist(), strict=True):
                ids, counts = _counted(text)
                at = np.minimum(np.searchsorted(chosen, ids), max(width - 2, 0))
                hit = chosen[at] == ids if len(chosen) else np.zeros(len(ids), bool)
                row[at[hit]] = np.log1p(counts[hit])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("doc_id"), pa.array([r.tobytes() for r in rows], pa.binary())], ["toxic", "doc_id", "row"])

    # at most POSITIVES + UNLABELLED rows of a bounded width
    rows = sorted(sample.mapInArrow(run, "toxic boolean, doc_id long, row binary").collect())
    of = lambda toxic: np.stack([np.frombuffer(r[2], np.float32) for r in rows if r[0] == toxic])
    return of(True), of(False)


def fit(pos: np.ndarray, unl: np.ndarray, prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights, the last one the bias, by full-batch Adam on the non-negative risk."""
    w = np.zeros(pos.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        w32 = w.astype(np.float32)
        gp, gu = (pos @ w32).astype(float), (unl @ w32).astype(float)
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad_positive = -prior * ((1 - sp).astype(np.float32) @ pos).astype(float) / len(pos)
        grad_negative = (su.astype(np.float32) @ unl).astype(float) / len(unl) - prior * (sp.astype(np.float32) @ pos).astype(float) / len(pos)
        grad = grad_positive + grad_negative if negative >= 0 else -grad_negative
        grad = grad + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def learn(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    """Weight by feature hash, the bias at -1; empty if there is nothing to learn from."""
    known = folds(columns_of(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")).where("not held_out")
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("long"))).first()
    if not toxic:
        return {}
    prior = min(max(toxic / n, 1e-3), 1 - 1e-3)
    d = columns_of(docs, "doc_id", "text")
    by_hash = [F.xxhash64(F.lit("fit"), "doc_id"), F.col("doc_id")]
    # both lists of ids are bounded by a parameter
    texts = d.where("doc_id is not null")
    pos_ids = known.where("toxic = 1").select("doc_id").distinct().orderBy(*by_hash).limit(POSITIVES)
    unl_ids = folds(texts.select("doc_id")).where("not held_out").select("doc_id").distinct().orderBy(*by_hash).limit(UNLABELLED)
    # one row an id, however often it comes
    picked = lambda ids, toxic: texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("toxic", F.lit(toxic))
    sample = written(picked(pos_ids, True).unionByName(picked(unl_ids, False)))
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return {}
    chosen = _chosen(sample, sizes[True], sizes[False])
    w = fit(*_dense(sample, chosen), prior)
    return {int(f): float(x) for f, x in zip(chosen, w, strict=False)} | {-1: float(w[-1])}


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs."""
    return _scores(columns_of(docs, "doc_id", "text"), learn(docs, labels))


def _scores(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    def run(batches):
        neutral, telling = set(), {}
        for b in bounded(batches):
            out = []
            for text in b.column("text").to_pylist():
                counts: dict[int, int] = {}
                for w in words_of(text).difference(neutral):
                    hits = telling.get(w)
                    if hits is None:
                        hits = tuple(f for f in features_of(w) if f in model)
                        if len(neutral) + len(telling) < REMEMBERED and len(w) <= LONGEST:
                            if hits:
                                telling[w] = hits
                            else:
                                neutral.add(w)
                    for f in hits:
                        counts[f] = counts.get(f, 0) + 1
                g = sum(model[f] * np.log1p(n) for f, n in sorted(counts.items())) + model.get(-1, -np.inf)
                out.append(float(1 / (1 + np.exp(-np.clip(g, -700, 700)))) if model else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, "score"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    s = docs.mapInArrow(run, f"{schema}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return folds(s).select("doc_id", "held_out", "score", "predicted") if docs.columns == ["doc_id", "text"] else s


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they were."""
    return _scores(docs, learn(docs, labels)).where("predicted = 0").drop("score", "predicted")
