"""The best points of many questions: blocks of both are multiplied as matrices where the points lie, and k points a question stay.

Products of matrices choose the candidates, with some room for rounding; the candidates' cosines are then summed row by row
in one order, so equal vectors have equal cosines, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ENTITY_FIELDS = ("drugs", "diseases", "procedures")
#: What a question may ask for, and the field of a point that answers it; types are a must, of the others one has to hold.
ANSWERS = {"types": "type", "chunk_types": "chunk_type", **{f: f for f in ENTITY_FIELDS}, "answer_filter": "answer_types"}
#: Numbers of a block of products, pairs whose cosines are summed at once, room for rounding.
NUMBERS, PAIRS, ROOM = 1 << 22, 1 << 16, 1e-9


def units(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of that length that have a direction, and their unit vectors."""
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False))
    m = pc.fill_null(column.take(pa.array(rows)).flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False).reshape(-1, length)
    with np.errstate(all="ignore"):
        n = np.sqrt((m * m).sum(1))
        m = m / n[:, None]
    good = np.isfinite(n) & (n > 0)
    return rows[good], m[good]


def sharing(asked: list[list | None], column: pa.Array) -> np.ndarray:
    """Whether each question's list (rows) and each point's value or list (columns) share a value; nulls share none."""
    out = np.zeros((len(asked), len(column)), bool)
    lists = pa.types.is_list(column.type)
    owner = pc.list_parent_indices(column).to_numpy() if lists else np.arange(len(column))
    coded = (column.flatten() if lists else column).dictionary_encode()
    codes = pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)
    same: dict[tuple, list[int]] = {}
    for i, values in enumerate(asked):
        if values:
            same.setdefault(tuple(sorted({v for v in values if v is not None})), []).append(i)
    for values, rows in same.items():
        wanted = np.append(pc.is_in(coded.dictionary, pa.array(values, coded.dictionary.type)).to_numpy(zero_copy_only=False), False)
        hit = np.zeros(len(column), bool)
        hit[owner[wanted[codes]]] = True
        out[rows] = hit
    return out


class Best:
    """The k best points so far of questions of one collection: columns _no, vector and whichever filters are set."""

    def __init__(self, asked: dict[str, list], k: int, mode: str):
        self.no, self.k = np.array(asked["_no"], np.int64), k
        lengths = np.array([len(v) for v in asked["vector"]], int)
        self.of = {int(n): (rows := np.flatnonzero(lengths == n), np.array([asked["vector"][i] for i in rows], float)) for n in np.unique(lengths)}
        self.asked = {f: asked[f] for f in ANSWERS if (f == "types" or mode != "boost_only") and any(asked[f])}
        self.bound = np.full(len(self.no), -2.0)
        self.kept: pa.Table | None = None

    def allowed(self, points: pa.RecordBatch) -> np.ndarray | None:
        """Which questions (rows) may get which points; None: all."""
        must, some, unset = None, None, None
        for field, asked in self.asked.items():
            free = np.array([not x for x in asked])[:, None]
            shared = sharing(asked, points.column(ANSWERS[field]))
            if field == "types":
                must = free | shared
            else:
                some, unset = (shared, free) if some is None else (some | shared, unset & free)
        other = None if some is None else unset | some
        return must if other is None else other if must is None else must & other

    def feed(self, points: pa.RecordBatch, among: np.ndarray | None = None) -> None:
        """Take in points (id, embedding, what filters look at). among: the questions that ask for them, by default all."""
        step = max(1, NUMBERS // max(1, len(self.no) if among is None else int(among.sum())))
        for begin in range(0, points.num_rows, step):
            self._take(points.slice(begin, step), among)

    def _take(self, points: pa.RecordBatch, among) -> None:
        allowed, place, found = self.allowed(points), None, []
        for length, (rows, q) in self.of.items():
            if among is not None:
                q, rows = q[among[rows]], rows[among[rows]]
            at, p = units(points.column("embedding"), length)
            if not len(rows) or not len(at):
                continue
            s = q @ p.T
            if allowed is not None:
                s[~allowed[np.ix_(rows, at)]] = -3
            bound = self.bound[rows]
            many = np.flatnonzero((s >= bound[:, None] - ROOM).sum(1) > 2 * self.k)
            if len(many):
                bound[many] = np.maximum(bound[many], np.partition(s[many], s.shape[1] - self.k, axis=1)[:, -self.k])
            i, j = np.nonzero(s >= np.maximum(bound, -2)[:, None] - ROOM)
            if not len(i):
                continue
            cosine = np.concatenate([(p[j[a : a + PAIRS]] * q[i[a : a + PAIRS]]).sum(1) for a in range(0, len(i), PAIRS)])
            if place is None:
                place = np.empty(points.num_rows, int)
                place[pc.sort_indices(points.column("id"), null_placement="at_start").to_numpy()] = np.arange(points.num_rows)
            order = np.lexsort((place[at[j]], -cosine, i))
            order = order[_ranks(i[order]) < self.k]
            found.append((rows[i[order]], cosine[order], at[j[order]]))
        if found:
            no, cosine, at = map(np.concatenate, zip(*found, strict=True))
            new = pa.Table.from_batches([points.drop_columns("embedding")]).take(pa.array(at)).append_column("_q", pa.array(no)).append_column("original_score", pa.array(cosine))
            self._keep(new)

    def _keep(self, new: pa.Table) -> None:
        t = new if self.kept is None else pa.concat_tables([self.kept, new])
        order = pc.sort_indices(t, sort_keys=[("_q", "ascending"), ("original_score", "descending"), ("id", "ascending")], null_placement="at_start").to_numpy()
        rank = _ranks(t["_q"].to_numpy()[order])
        self.kept = t.take(pa.array(order[rank < self.k])).combine_chunks()
        last = order[rank == self.k - 1]
        self.bound[t["_q"].to_numpy()[last]] = t["original_score"].to_numpy()[last]

    def rows(self) -> pa.Table | None:
        """The best points, each with _no and original_score."""
        if self.kept is None:
            return None
        return self.kept.append_column("_no", pa.array(self.no[self.kept["_q"].to_numpy()])).drop_columns("_q")


def _ranks(sorted_: np.ndarray) -> np.ndarray:
    """The place of each row among those of its group; groups stand together."""
    n = np.arange(len(sorted_))
    new = np.append(True, sorted_[1:] != sorted_[:-1]) if len(sorted_) else np.zeros(0, bool)
    return n - np.maximum.accumulate(np.where(new, n, 0)) if len(sorted_) else n


def best(asked: dict[str, list], points: Iterable[pa.RecordBatch], k: int, mode: str) -> pa.Table | None:
    b = Best(asked, k, mode)
    for batch in points:
        b.feed(batch)
    return b.rows()
