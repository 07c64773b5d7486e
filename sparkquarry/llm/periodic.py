"""Periodic runs of words: block matching in each text, then exact extension.

A run is a stretch of words with smallest period q and a length of max(LEAST, TIMES * q) or more that no neighbouring word
extends.  Runs with q from B to 2B - 1, B a power of two, are sought together.  A run of four periods holds an aligned
block of B words and that block's copy q words on.  So a text's aligned blocks are the keys, sequences of word numbers, of
an Aho-Corasick automaton that is searched across the whole text; an occurrence at x can only mean a run with the one
aligned block that begins at a distance of B to 2B - 1 before it.  Where that block is the one that occurred, the distance
is a seed, and the seed is extended word by word in both directions.  A stretch is a run if it is long enough and no
proper divisor of the distance is a period of it.

Most blocks are no keys, without loss: words of a run recur within 2B - 1 words, and so do, in the first block of a run,
all sequences of up to B words that begin in it; blocks of which one does not recur go.  Copies inside a run that is
known already can only find it again.  A distance's stretch is extended once.

Texts are independent: one pass in Arrow batches bounded in bytes, without any exchange.  A text's work grows with its
length times its logarithm, and one text is held at a time.

Defined results: null, empty and blank texts have no words and no runs; texts of any length are taken whole; rows are
rows, repeated or not, with or without an id; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, columns_of

#: Words of the shortest run, periods that a run has at least (the search relies on four or more).
LEAST, TIMES = 6, 4
#: Words of the sequences whose recurrence is asked of a block.
_GRAM = 4
_FAR = np.int64(1) << 62


def numbered(words: list[bytes]) -> np.ndarray:
    """The words as numbers, in order of first appearance."""
    ids: defaultdict = defaultdict(count().__next__)
    return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))


def _gaps(w: np.ndarray) -> np.ndarray:
    """How many words after each place the sequence of _GRAM words there comes again (or one of the same hash, earlier)."""
    h = w[: len(w) - _GRAM + 1].astype(np.uint64)
    for i in range(1, _GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(w) - _GRAM + 1 + i].astype(np.uint64)
    order = np.argsort(h, kind="stable")
    again = h[order[1:]] == h[order[:-1]]
    gaps = np.full(len(w), _FAR)
    gaps[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return gaps


def _extended(w: np.ndarray, i: int, j: int, d: int) -> tuple[int, int]:
    """The largest lo..hi around i..j where each word is the one d words on."""
    n, step = len(w) - d, 64
    while j < n:
        end = min(j + step, n)
        odd = np.flatnonzero(w[j:end] != w[j + d : end + d])
        if len(odd):
            j += int(odd[0])
            break
        j, step = end, step * 2
    step = 64
    while i > 0:
        begin = max(i - step, 0)
        odd = np.flatnonzero(w[begin:i] != w[begin + d : i + d])
        if len(odd):
            i = begin + int(odd[-1]) + 1
            break
        i, step = begin, step * 2
    return i, j


def _primes(d: int) -> list[int]:
    out, p = [], 2
    while p * p <= d:
        if d % p == 0:
            out.append(p)
            while d % p == 0:
                d //= p
        p += 1
    return [*out, d] if d > 1 else out


def _seeds(words: tuple, block: int, starts: list[int], reach: list[int]):
    """(place, distance) of each occurrence of an aligned block with that block 1 to 2 lengths before it.

    reach: how far a known run of a smaller period goes from each block; an occurrence that ends there tells nothing new.
    """
    keys, at = {}, {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    spans: list[list[int]] = []
    for s, known in zip(starts, reach, strict=True):
        key = words[s : s + block]
        if key not in keys:
            keys[key] = len(keys)
            automaton.add_word(key, keys[key])
        at[s] = (keys[key], known)
        if spans and s <= spans[-1][1]:
            spans[-1][1] = s + 3 * block
        else:
            spans.append([s, s + 3 * block])
    automaton.make_automaton()
    for begin, end in spans:
        for last, key in automaton.iter(words[begin:end]):
            x = begin + last - block + 1
            s = (x - block) // block * block
            own, known = at.get(s, (None, 0))
            if own == key and x + block > known:
                yield s, x - s


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers below 2^32, by start, then period."""
    n, found, words = len(w), [], None
    block, widest = 1, None
    while n >= max(LEAST, TIMES * block):
        # the furthest next occurrence in each aligned block that a copy can follow
        if block == 1:
            near = np.flatnonzero(w[1:] == w[:-1])
        elif block == 2:
            recurs = w[:-2] == w[2:]
            recurs[:-1] |= w[:-3] == w[3:]
            pairs = len(recurs) // 2
            near = 2 * np.flatnonzero(recurs[: 2 * pairs].reshape(pairs, 2).all(1))
        else:
            if widest is None:
                widest = _gaps(w)[: n // block * block].reshape(-1, block).max(1)
            else:
                widest = widest[: len(widest) // 2 * 2].reshape(-1, 2).max(1)
            near = block * np.flatnonzero(widest < 2 * block)
        if len(near) and found:
            runs = np.array(sorted(found), np.int64)
            ends = np.concatenate([[0], np.maximum.accumulate(runs[:, 0] + runs[:, 1])])
            reach = ends[np.searchsorted(runs[:, 0], near, "right")]
            near, reach = (x[reach < np.minimum(near + 3 * block, n)] for x in (near, reach))
        else:
            reach = np.zeros(len(near), np.int64)
        if len(near):
            words = words or tuple(w.tolist())
            known: dict[int, tuple[int, int]] = {}
            for s, d in _seeds(words, block, near.tolist(), reach.tolist()):
                lo, hi = known.get(d, (0, 0))
                if lo <= s and s + block <= hi:
                    continue
                lo, hi = known[d] = _extended(w, s, s + block, d)
                end = hi + d
                if end - lo >= max(LEAST, TIMES * d) and not any((w[lo : end - d // p] == w[lo + d // p : end]).all() for p in _primes(d)):
                    found.append((lo, end - lo, d))
        block *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def detected(docs: DataFrame, prepare: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """doc_id, runs (start, length, period of each) and collapsed (the words outside of repetitions, joined by spaces).

    prepare: what is done to a text's words before they are searched.
    """

    def run(batches):
        for b in bounded(batches):
            found, texts = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()
                if prepare:
                    words = prepare(words, i)
                runs = runs_of(numbered(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                texts.append(b" ".join(collapsed(words, runs)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return columns_of(docs, "doc_id", "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, of every tenth id with a tail that repeats."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g = h // 10
    a = g % len(words)
    rest = len(words) - a
    p = 1 + rest // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (rest // p + 1))[:rest]


def digests(docs: DataFrame) -> DataFrame:
    """The runs of each document, some with a planted tail: how many, the longest, and SHA-256 of all of them and of what is left."""
    d = detected(docs, planted)
    order = lambda a, b: F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"])).when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["period"] - b["period"])).cast("int")
    d = d.withColumn("best", F.get(F.array_sort("runs", order), F.lit(0)))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    all_runs = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(all_runs).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
