"""Hard-negative mining by a secondary-sort shuffle.

For each anchor the rows of its own label are scored, and the first ones in descending order of score are its positives.
A positive of score p opens a window of scores, from `low` to `high` hundredths of p; the first rows of other labels in it
are its hard negatives. Pairs are shuffled by anchor and sorted within partitions by (anchor, descending score, id), so
one iterator meets each anchor's rows in the order of the result: it opens a window at each positive, hands out
negatives to the open windows, and holds nothing but their bounds.

Blocks of rows meet blocks of anchors. A task keeps per anchor only the rows that can still be in a result, since any
other comes after enough better ones of the same task: first the best of the same label, from which the iterator takes
the positives, then the best of other labels in the windows of these. What is shuffled thus does not grow with the rows
of a label. Scores are integers, so the result is the same however rows are laid out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from towline.session import cut

from .vectors import as_matrix, met, query_blocks, row_blocks

BLOCK_ROWS = 4096
_NO_SCORE, _NO_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two int64 matrices; raises if one may not fit 64 bits."""
    bound = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * a.shape[1]
    if bound < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if bound >= 2.0**63:
        raise OverflowError("an inner product of these vectors may not fit 64 bits")
    return a @ b.T


class Best:
    """The first `k` of the rows offered to each slot, by descending score and ascending id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _NO_SCORE)
        self.ids = np.full((slots, k), _NO_ID)

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        into = np.unique(slot)
        if not len(into):
            return
        old = np.repeat(into, self.k), self.score[into].ravel(), self.ids[into].ravel()
        slot, score, ids = (np.concatenate(x) for x in zip(old, (slot, score, ids)))
        order = np.lexsort((ids, ~score, slot))  # ~x falls as x rises, and does not overflow
        slot, score, ids = slot[order], score[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        first = starts[:, None] + np.arange(self.k)  # every slot has its k old entries at least
        self.score[into], self.ids[into] = score[first], ids[first]


def _share(score: np.ndarray, hundredths: int, up: bool) -> np.ndarray:
    """`hundredths` of non-negative scores, rounded up or down."""
    rest = score % 100 * hundredths
    return score // 100 * hundredths + (-(-rest // 100) if up else rest // 100)


_PAIRS = "anchor_id bigint, score bigint, id bigint"


def _kept(pairs: DataFrame, start: Callable, offer: Callable) -> DataFrame:
    """The rows that the blocks of anchors keep in each task.

    `start(cell, n)` gives a block's Best and its slots per anchor and whatever else `offer` needs; `offer(state, scores, cell)` adds rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[int, tuple] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for anchors, (best, per, _) in states.values():
                slot, at = np.nonzero(best.ids != _NO_ID)
                score, ids = best.score[slot, at], best.ids[slot, at]
                # A row is kept once for all slots of its anchor; rows that are repeated stay as many.
                again = (np.diff(slot, prepend=-1) == 0) & (np.diff(score, prepend=0) == 0) & (np.diff(ids, prepend=-1) == 0)
                since = np.arange(len(slot)) - np.maximum.accumulate(np.where(again, 0, np.arange(len(slot)))) if len(slot) else slot
                unique = np.unique(np.stack([anchors[slot // per], score, ids, since]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in unique[:3]], names=["anchor_id", "score", "id"])
            states.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                cell = lambda name: batch.column(name)[i]  # noqa: B023, E731
                listed = lambda name: cell(name).values.to_numpy()  # noqa: B023, E731
                anchors = listed("q_ids")
                key = int(anchors[0])  # ids of anchors are unique, so the first one names the block
                if key not in states:
                    if len(states) >= 64:
                        yield from rows()
                    states[key] = anchors, start(listed, len(anchors))
                a, b = (as_matrix(cell(p + "data").as_buffer(), cell("dims").as_py(), np.int64) for p in ("q_", ""))
                offer(states[key][1], inner_products(a, b), listed)
        yield from rows()

    return pairs.mapInArrow(run, _PAIRS)


def _sorted_by_anchor(rows: DataFrame) -> DataFrame:
    """The secondary sort: partitioned by anchor, and sorted within partitions by (anchor, descending score, id)."""
    return rows.repartition("anchor_id").sortWithinPartitions("anchor_id", F.desc("score"), "id")


def _first_per_anchor(rows: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, n = None, 0
        for batch in batches:
            taken = []
            for at, own in enumerate(batch.column("anchor_id").to_pylist()):
                anchor, n = own, n + 1 if own == anchor else 1
                if n <= k:
                    taken.append(at)
            yield batch.take(pa.array(taken, pa.int64()))

    return _sorted_by_anchor(rows).mapInArrow(run, _PAIRS)


_FIELDS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _windows(rows: DataFrame, negatives: int, low: int, high: int) -> DataFrame:
    """Stream each anchor's rows in descending order of score; a positive opens a window, and negatives fill the open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, level, tied = None, [], None, []
        for batch in batches:
            out: list[tuple] = []
            for own, score, row, positive in zip(*(batch.column(c).to_pylist() for c in ("anchor_id", "score", "id", "positive"))):
                if own != anchor:
                    anchor, windows, level, tied = own, [], None, []
                if positive:
                    # Its bounds, and how many negatives it has; it is compared with those of the same score that came before.
                    window = [row, score, 0]
                    windows.append(window)
                    candidates = tied if level == score else []
                    asked = [window]
                else:
                    if score != level:
                        level, tied = score, []
                    if len(tied) < negatives:
                        tied.append(row)
                    candidates, asked = (row,), windows
                for window in asked:
                    top = window[1]
                    for candidate in candidates:
                        if window[2] < negatives and low * top <= 100 * score <= high * top:
                            window[2] += 1
                            out.append((anchor, window[0], window[2], candidate, top, score))
            columns = list(zip(*out)) or [()] * len(_FIELDS)
            kinds = [pa.int32() if f == "rank" else pa.int64() for f in _FIELDS]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(_FIELDS))

    schema = ", ".join(f"{f} {'int' if f == 'rank' else 'bigint'}" for f in _FIELDS)
    return _sorted_by_anchor(rows).mapInArrow(run, schema)


def hard_negatives(rows: DataFrame, anchors: DataFrame, id: str = "vec_id", label: str = "label", vector: str = "vector",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of `anchors` among `rows`.

    Scores are inner products of vectors of integers. An anchor's positives are its first rows of the same label, by descending
    score and ascending id; a positive's negatives are the first rows of other labels whose score lies between `low` and `high` hundredths
    of its own, both included. A positive with a negative score has none. Ids and labels are integers.

    Rows without id, label or vector take no part, and vectors meet those of the same length only. Rows with an anchor's id
    are the anchor itself and not its candidates; other repeated rows are candidates each. Of anchors with
    the same id, the one with the least label and vector asks. Other columns are not read. Empty tables give an empty
    result. Scores that may not fit 64 bits are an error.
    """
    if not 0 <= low <= high <= 100:
        raise ValueError("a window lies between 0 and 100 hundredths of the positive's score")
    usable = lambda df: df.select(
        F.col(id).cast("bigint").alias("ids"), F.col(label).cast("bigint").alias("labels"), F.col(vector).cast("array<bigint>").alias("__vector")
    ).filter(F.col("ids").isNotNull() & F.col("labels").isNotNull() & F.col("__vector").isNotNull() & ~F.exists("__vector", F.isnull))
    asked = cut(usable(anchors).groupBy("ids").agg(F.min(F.struct("labels", "__vector")).alias("a")).select("ids", "a.*"))
    blocks = row_blocks(usable(rows), ["ids", "labels"], "__vector", BLOCK_ROWS)

    def best_of_label(listed, n):
        return Best(n, positives), 1, None

    def offer_own(state, scores, listed):
        best = state[0]
        fits = (listed("q_labels")[:, None] == listed("labels")) & (listed("q_ids")[:, None] != listed("ids")) & (scores >= best.score[:, -1:])
        slot, row = np.nonzero(fits)
        best.offer(slot, scores[slot, row], listed("ids")[row])

    own = cut(_first_per_anchor(_kept(met(blocks, query_blocks(asked, ["ids", "labels"], "__vector")), best_of_label, offer_own), positives))

    tops = own.groupBy("anchor_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("p"))  # `positives` scores at most
    names = [f"p{j}" for j in range(positives)]
    opened = asked.join(tops, asked["ids"] == tops["anchor_id"]).select("ids", "labels", "__vector", *[
        F.coalesce(F.get("p", F.lit(j)), F.lit(-1)).alias(c) for j, c in enumerate(names)])

    def best_of_windows(listed, n):
        top = np.stack([listed(f"q_{c}") for c in names], 1)
        least = np.where(top >= 0, _share(np.maximum(top, 0), low, True), 1)
        most = np.where(top >= 0, _share(np.maximum(top, 0), high, False), 0)
        return Best(n * positives, negatives), positives, (least, most)

    def offer_others(state, scores, listed):
        best, _, (least, most) = state
        other = listed("q_labels")[:, None] != listed("labels")
        limit = best.score[:, -1].reshape(-1, positives)
        for j in range(positives):
            fits = other & (scores >= np.maximum(least[:, j], limit[:, j])[:, None]) & (scores <= most[:, j, None])
            slot, row = np.nonzero(fits)
            best.offer(slot * positives + j, scores[slot, row], listed("ids")[row])

    others = _kept(met(blocks, query_blocks(opened, ["ids", "labels", *names], "__vector")), best_of_windows, offer_others)
    both = own.withColumn("positive", F.lit(True)).unionByName(others.withColumn("positive", F.lit(False)))
    return _windows(both, negatives, low, high)
