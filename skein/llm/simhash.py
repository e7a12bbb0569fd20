"""Near duplicates by 64-bit SimHash fingerprints that differ in at most three bits, found at the anchors of a covering code.

Of two fingerprints at three or fewer differing bits, one 32-bit half differs in at most one. The anchors of a half are the
words of the Hamming code of length 31 with a free bit: every half has exactly one anchor within the covering radius of one, its
home. Halves at a distance of one therefore meet at the home of either, if each fingerprint also visits all
anchors within radius plus threshold, which are at most 17 per half. Fingerprints are compared where they meet.

Equal fingerprints are one row from the start, so copies cost nothing. Anchors with more fingerprints than a task should compare are
dealt out as pairs of blocks, which compare the same pairs in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import id_and_text, runs, schema, text_key
from skein.llm.components import components
from skein.session import cut

MOST_BITS = 3
SEED = 42
# Fingerprints that are compared with each other in one go.
BLOCK = 4096
_SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """SimHash of the shingles of the lower-cased (A-Z) words of ``text``, as a signed 64-bit number.

    A bit is set when more than half of the XXH64 values of the shingles, repeats included, have it. Fewer words than a shingle has are one
    shingle; no words give zero.
    """
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    starts, ends = starts[:n].tolist(), ends[min(shingle_words, len(words)) - 1 :].tolist()
    digest = partial(xxh64_digest, seed=SEED)
    ones = np.zeros(64, np.int64)
    for first in range(0, n, _SHINGLES_AT_ONCE):
        last = first + _SHINGLES_AT_ONCE
        hashes = b"".join(map(digest, [joined[a:b] for a, b in zip(starts[first:last], ends[first:last])]))
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint long`` and the ``text_key`` of every row; a null text counts as empty."""
    out = schema(docs, id_col, fingerprint="long", text_key="long")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = pa.array([fingerprint(t, shingle_words) for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), prints, batch.column(2)], ["doc_id", "fingerprint", "text_key"])

    return id_and_text(docs, id_col, text_col).withColumn("text_key", text_key()).mapInArrow(run, out)


def _parity(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values).astype(np.int64) & 1


# For each bit of the syndrome, the places (1 to 31, kept in bits 0 to 30) whose number has that bit.
_CHECKS = [sum(1 << (place - 1) for place in range(1, 32) if place >> j & 1) for j in range(5)]


def syndrome(halves: np.ndarray) -> np.ndarray:
    """Place of the bit to flip for a word of the code; 0 where the lower 31 bits are one already."""
    return sum(_parity(halves & check) << j for j, check in enumerate(_CHECKS))


def anchors(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, anchor, home)``: the anchors within two bits of each 32-bit half, and whether one is within a single bit
    with the same free bit (bit 31)."""
    halves = halves.astype(np.int64)
    places = syndrome(halves)
    flip = np.where(places > 0, np.left_shift(1, np.maximum(places - 1, 0)), 0)
    near = halves ^ flip
    index = np.arange(len(halves))
    rows, found, home = [index, index], [near, near ^ (1 << 31)], [np.ones(len(halves), bool), np.zeros(len(halves), bool)]
    for i in range(1, 32):
        j = places ^ i
        some = np.flatnonzero((places > 0) & (j > i))
        rows.append(some)
        found.append(halves[some] ^ (1 << (i - 1)) ^ np.left_shift(1, j[some] - 1))
        home.append(np.zeros(len(some), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _meetings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints to ``(anchor, fingerprint, home)``; the two halves have anchors of their own."""
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for half, values in enumerate((prints >> np.uint64(32), prints & np.uint64(0xFFFFFFFF))):
            rows, found, home = anchors(values)
            yield pa.record_batch([pa.array(found | half << 32), pa.array(prints[rows].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])


def local_links(prints: np.ndarray, home: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(root, member)`` that join what pairs at ``MOST_BITS`` or fewer bits join, at most one per fingerprint.

    Pairs count when one of the two is at home; with ``side``, when they also stand on different sides.
    """
    parent = np.arange(len(prints))
    bits = prints.view(np.uint64)  # numpy counts the bits of absolute values

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in np.flatnonzero(home).tolist():
        close = np.bitwise_count(bits ^ bits[i]) <= MOST_BITS
        if side is not None:
            close &= side != side[i]
        for j in np.flatnonzero(close).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    roots = np.fromiter(map(root, range(len(prints))), np.int64, len(prints))
    members = np.flatnonzero(roots != np.arange(len(prints)))
    return prints[roots[members]], prints[members]


def _sorted_groups(batches: Iterable[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of each group of equal first columns in sorted batches, with True; groups of more than ``most`` rows come in parts, with False."""
    held: list[np.ndarray] | None = None
    passing = None  # key of a group that is passed on in parts
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
        starts = runs(columns[0])
        for a, b in zip(starts[:-2].tolist(), starts[1:-1].tolist()):
            part = [c[a:b] for c in columns]
            yield part, part[0][0] != passing and (most is None or b - a <= most)
        held = [c[starts[-2] if len(starts) > 1 else 0 :] for c in columns]
        if len(held[0]) and (held[0][0] == passing or most is not None and len(held[0]) > most):
            passing = held[0][0]
            yield held, False
            held = None
    if held is not None and len(held[0]):
        yield held, held[0][0] != passing and (most is None or len(held[0]) <= most)


def _compare(most: int):
    """Sorted ``(anchor, fp, home)`` to links ``(a, b, null)``; rows of larger anchors go on as ``(anchor, fp, home)``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for (anchor, prints, home), whole in _sorted_groups(batches, most):
            if not whole:
                yield pa.record_batch([pa.array(anchor), pa.array(prints), pa.array(home.astype(bool))], ["a", "b", "home"])
            elif len(prints) > 1 and home.any():
                roots, members = local_links(prints, home.astype(bool))
                a.append(roots)
                b.append(members)
            if len(a) >= 10_000:
                yield _links(a, b)
                a, b = [], []
        yield _links(a, b)

    return run


def _links(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    a, b = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (a, b))
    return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.bool_())], ["a", "b", "home"])


def _compare_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(pair of blocks, fp, home, side)`` to links."""
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for (_, prints, home, side), _ in _sorted_groups(batches):
        both = len(np.unique(side)) > 1
        roots, members = local_links(prints, home.astype(bool), side if both else None)
        a.append(roots)
        b.append(members)
    yield _links(a, b)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links that connect all distinct ``prints(fp)`` at three or fewer differing bits, and no others."""
    met = prints.select("fp").mapInArrow(_meetings, "anchor long, fp long, home boolean")
    met = met.repartition("anchor").sortWithinPartitions("anchor")
    found = cut(met.mapInArrow(_compare(block), "a long, b long, home boolean"), "met")
    direct = found.filter(F.isnull("home")).select("a", "b")
    large = found.filter(F.isnotnull("home")).select(F.col("a").alias("anchor"), F.col("b").alias("fp"), "home")
    if large.isEmpty():
        return direct
    sizes = cut(large.groupBy("anchor").count().select("anchor", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "sizes")
    dealt = large.join(sizes, "anchor").withColumn("side", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pair = F.xxhash64("anchor", F.least("side", "other"), F.greatest("side", "other"))
    dealt = dealt.select(pair.alias("pair"), "fp", "home", "side").repartition("pair").sortWithinPartitions("pair")
    return direct.unionByName(dealt.mapInArrow(_compare_blocks, "a long, b long, home boolean").select("a", "b"))


def near_duplicates(
    docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK
) -> DataFrame:
    """``doc_id, fingerprint`` (16 lower-case hex digits), ``component_id`` and ``text_key`` for every row of ``docs``.

    ``component_id`` is the smallest id that links of three or fewer differing bits reach, the row's own included. Null and
    empty texts have the fingerprint zero and link like any other; null ids never name a component unless it has no other id; rows
    that repeat an id stand each for itself. An empty table gives no rows; other columns are ignored.
    """
    own = cut(fingerprints(docs, shingle_words, id_col, text_col), "fingerprints")
    distinct = cut(own.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first_id")), "distinct")
    labels = components(links(distinct, block))
    labelled = cut(
        distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "labelled",
    )
    smallest = cut(labelled.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    named = cut(labelled.join(smallest, "label").select(F.col("fp").alias("fingerprint"), "component_id"), "named")
    return own.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "text_key"
    )
