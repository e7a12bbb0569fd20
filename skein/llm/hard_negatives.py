"""Hard negatives by exact search over sorted coordinate lists, with the lengths of vectors in buckets.

Components are whole numbers (``floor(scale * x)``), so inner products are exact. In a task, vectors are put into buckets of about the same length,
longest first. Of an anchor and a least score to reach, a bucket can hold a partner only if the product of the lengths reaches it. If so, the angle to
the anchor is bounded, and with it each coordinate of the partner's direction: the bucket keeps its directions in one sorted list per coordinate, the
anchor's largest coordinates (its focus) each give a range of a list, and what lies in all ranges is verified by its inner product.

Positives are searched first; the scores of an anchor's positives then are the least scores and the upper limits for its negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked
from skein.llm.vectors import first_of_ids, matrix, met_in_buckets, number_of_buckets, usable, vector_column
from skein.session import cut

# Vectors of a length bucket, how much shorter than its longest its shortest may be, and coordinates of an anchor that give ranges.
BUCKET_ROWS = 2048
SHORTEST = 0.9
FOCUS = 4
# Room for rounding where bounds are worked out in doubles.
SLACK = 1e-9
# Inner products below this are exact in doubles.
_EXACT = float(1 << 53)


class LengthBucket:
    """Vectors of similar length, with a sorted list of directions for every coordinate that was in focus so far."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.codes, self.ids, self.labels = codes, ids, labels
        self.longest = float(lengths.max())
        self.directions = codes / np.where(lengths > 0, lengths, 1)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted values of a coordinate, the vectors in that order, and the place of each vector."""
        known = self.lists.get(coordinate)
        if known is None:
            values = self.directions[:, coordinate]
            order = np.argsort(values, kind="stable")
            places = np.empty(len(order), np.int64)
            places[order] = np.arange(len(order))
            known = self.lists[coordinate] = values[order], order, places
        return known

    def candidates(self, focus: list[int], angles: np.ndarray, cosine: float) -> np.ndarray | slice:
        """Vectors that may reach ``cosine``: those in the feasible range of every coordinate in focus.

        A direction at an angle of at most d to the anchor's has coordinates whose own angles are at most d from the anchor's ``angles``.
        """
        if cosine <= -1:
            return slice(None)
        apart = np.arccos(min(1.0, cosine))
        lows = np.cos(np.minimum(np.pi, angles + apart)) - SLACK
        highs = np.cos(np.maximum(0.0, angles - apart)) + SLACK
        ranges = []
        for coordinate, low, high in zip(focus, lows.tolist(), highs.tolist()):
            values, order, places = self.sorted_list(coordinate)
            first, last = int(values.searchsorted(low)), int(values.searchsorted(high, "right"))
            if last - first < len(values):
                ranges.append((last - first, first, last, order, places))
        if not ranges:
            return slice(None)
        ranges.sort(key=lambda r: r[0])
        _, first, last, order, _ = ranges[0]
        found = order[first:last]
        for _, first, last, _, places in ranges[1:]:
            at = places[found]
            found = found[(at >= first) & (at < last)]
        return found


class Anchor:
    """An anchor with its length, its focus and the angles of the coordinates in focus."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        self.length = float(np.sqrt(codes @ codes))
        direction = codes / self.length if self.length else codes
        focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
        self.focus = focus.tolist()
        self.angles = np.arccos(np.clip(direction[focus], -1, 1))


class LengthBuckets:
    """All vectors of a task, longest bucket first."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: int = BUCKET_ROWS) -> None:
        lengths = np.sqrt(np.einsum("ij,ij->i", codes, codes))
        order = np.lexsort((ids, -lengths))
        codes, lengths, ids, labels = codes[order], lengths[order], ids[order], labels[order]
        self.buckets, first = [], 0
        while first < len(ids):
            same = np.searchsorted(-lengths, -SHORTEST * lengths[first], "right")
            last = min(first + rows, max(int(same), first + 1))
            at = slice(first, last)
            self.buckets.append(LengthBucket(codes[at], lengths[at], ids[at], labels[at]))
            first = last

    def reaching(self, anchor: Anchor, least) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Exact scores, ids and labels of vectors bucket by bucket, all with a score of ``least()`` or more among them."""
        for bucket in self.buckets:
            most = anchor.length * bucket.longest
            score = least()
            if score > most * (1 + SLACK):
                return
            # a score of zero or less is reached at any length, so no angle is ruled out
            cosine = score / most - SLACK if score > 0 and most > 0 else -1.0
            at = bucket.candidates(anchor.focus, anchor.angles, cosine)
            if most < _EXACT:
                scores = np.rint(bucket.codes[at] @ anchor.codes).astype(np.int64)
            else:
                asked = [int(x) for x in anchor.codes]
                scores = np.array([sum(int(x) * y for x, y in zip(row, asked)) for row in bucket.codes[at]], object).astype(np.int64)
            yield scores, bucket.ids[at], bucket.labels[at]


class Best:
    """The first ``most`` of the scores shown so far, higher ones first, then smaller ids."""

    def __init__(self, most: int) -> None:
        self.most = most
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores):
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            order = np.lexsort((ids, -scores))[: self.most]
            self.scores, self.ids = scores[order], ids[order]

    def least(self, otherwise: float) -> float:
        """What a score must reach to come in."""
        return max(otherwise, int(self.scores[-1])) if len(self.scores) == self.most else otherwise


def quantised(column: pa.Array, scale: int, width: int | None = None) -> np.ndarray:
    return np.floor(scale * matrix(column, width))


def _loaded(table: pa.Table, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components, ids and labels of a task's vectors, one row for each id."""
    ids = table.column("id").to_numpy()
    labels = table.column("label").to_numpy()
    if len(np.unique(ids)) < len(ids):
        keep = pa.array(first_of_ids(ids, labels.tolist(), table.column("vector").to_pylist()))
        table = table.take(keep)
        ids, labels = ids[keep], labels[keep]
    return quantised(table.column("vector"), scale), ids, labels


def _positives(scale: int, most: int):
    def answer(table: pa.Table):
        codes, ids, labels = _loaded(table, scale)
        by_label = {}
        order = np.argsort(labels, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
            if len(at):
                by_label[int(labels[at[0]])] = LengthBuckets(codes[at], ids[at], labels[at])

        def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = []
            asked = quantised(batch.column("vector"), scale, codes.shape[1])
            for own, label, row in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), asked):
                best, anchor = Best(most), Anchor(row)
                for scores, others, _ in by_label[label].reaching(anchor, lambda: best.least(-np.inf)) if label in by_label else ():
                    other = (others != own) & (scores >= best.least(-np.inf))
                    best.add(scores[other], others[other])
                found += [(own, i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["anchor_id", "positive_id", "positive_score"])

        return search

    return answer


def _negatives(scale: int, most: int, low: int, high: int):
    def answer(table: pa.Table):
        codes, ids, labels = _loaded(table, scale)
        index = LengthBuckets(codes, ids, labels)

        def search(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            found = []
            asked = quantised(batch.column("vector"), scale, codes.shape[1])
            for own, label, positives, row in zip(
                batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("positives").to_pylist(), asked
            ):
                # whole scores from low to high percent of the positive's, a window that may be empty
                windows = [(p, -(-low * p["score"] // 100), high * p["score"] // 100, Best(most)) for p in positives]
                windows = [w for w in windows if w[1] <= w[2]]
                if not windows:
                    continue
                ceiling = max(w[2] for w in windows)

                def least() -> float:
                    return min(best.least(bottom) for _, bottom, _, best in windows)

                for scores, others, kinds in index.reaching(Anchor(row), least):
                    fits = (scores >= least()) & (scores <= ceiling) & (kinds != label)
                    if fits.any():
                        scores, others = scores[fits], others[fits]
                        for _, bottom, top, best in windows:
                            inside = (scores >= best.least(bottom)) & (scores <= top)
                            best.add(scores[inside], others[inside])
                for p, _, _, best in windows:
                    found += [(own, p["id"], p["score"], i, s) for i, s in zip(best.ids.tolist(), best.scores.tolist())]
            columns = list(zip(*found)) or [()] * 5
            names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

        return search

    return answer


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows where ``anchors`` holds.

    A score is the inner product of the components ``floor(scale * x)``. An anchor's positives are the first ``positives`` other rows of its label;
    a positive's negatives the first ``negatives`` rows of other labels that score from ``low`` to ``high`` percent of it. Higher scores come first, ties by
    smaller id.

    Rows with a null id, label or vector, or a null or non-finite component take no part. Vectors shorter than others go on with zeros; empty ones score 0
    with all. Of rows that repeat an id, the one with the smallest label and vector counts. Anchors without positives or negatives, and empty tables, give no
    rows; other columns are ignored. Scores have to fit a long.
    """
    base = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector_column(rows, vector_col).alias("vector"),
        F.coalesce(anchors, F.lit(False)).alias("is_anchor"),
    )
    base = base.filter(F.isnotnull("id") & F.isnotnull("label") & usable(F.col("vector")))
    vectors = base.drop("is_anchor")
    first = F.min(F.struct("label", "vector")).alias("row")
    asked = base.filter("is_anchor").groupBy("id").agg(first).select("id", "row.label", "row.vector")
    asked = cut(asked, "anchors")
    buckets = number_of_buckets(vectors, "vector")

    found = met_in_buckets(vectors, asked, buckets, _positives(scale, positives), "anchor_id long, positive_id long, positive_score long")
    best = cut(ranked(found, ["anchor_id"], [F.desc("positive_score"), "positive_id"], positives), "positives")
    own = F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))
    per_anchor = best.groupBy(F.col("anchor_id").alias("id")).agg(own.alias("positives"))

    out = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    met = met_in_buckets(vectors, asked.join(per_anchor, "id"), buckets, _negatives(scale, negatives, low, high), out)
    hardest = ranked(met, ["anchor_id", "positive_id", "positive_score"], [F.desc("negative_score"), "negative_id"], negatives)
    return hardest.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
