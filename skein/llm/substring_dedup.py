"""Removal of word windows that an earlier document has too, with a count-min sketch in front of the exact grouping.

Every window of 50 words is named by the smallest of the hashes of its ten-word grams, so equal windows have equal names,
and a document has about one name for twenty words. Documents with equal word sequences collapse first. Then:

1. each partition counts the names of its documents in sketches, one per range of names; the sketches of a range are
   merged, and a name is estimated by its least counter, which never falls below its true count. The number of
   ranges follows the number of names, so a sketch stays as good and as small whatever the input;
2. only windows with a name estimated repeated are grouped exactly, by 128 bits over their words: first among those of a task,
   then the first of every task. A window is removed where a smaller document has it.

No repeated window is lost: its name occurs in two documents at least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.membership import bits_for, may_be_in, membership
from skein.llm.common import id_and_text, id_type, runs, text_key
from skein.llm.hashing import BASES, mix, rolling
from skein.session import cut

WINDOW = 50
GRAM = 10
# Count-min sketch of one range of names: rows of counters, and how many names a range gets on average.
SKETCH_ROWS = 2
SKETCH_WIDTH = 1 << 20
NAMES_PER_SKETCH = 200_000
_NAMES_AT_ONCE = 2_000_000
# Windows that a task compares before it gives them out, and rows of one batch.
_WINDOWS_AT_ONCE = 1_000_000
_ROWS_AT_ONCE = 100_000


def _sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """Least of every run of ``n`` neighbours."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    from xxhash import xxh3_128_digest

    both = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(-1, 2)
    return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])


def window_names(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The name of every window of a text with these word hashes."""
    return _sliding_least(mix(rolling(hashes, gram), 1), window - gram + 1)


def window_keys(words: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits over the words of every window, in two columns."""
    low, high = _word_hashes(words)
    return rolling(low, window, BASES[0]), rolling(high, window, BASES[1])


def _profile(window: int, gram: int, out: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            n_words, digests, names = [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = text.split()
                n_words.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                found = np.unique(window_names(_word_hashes(words)[0], window, gram)) if len(words) >= window else np.zeros(0, np.uint64)
                names.append(found.view(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()), pa.array(names, pa.list_(pa.int64()))]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return run


def sketch_places(names: np.ndarray, shards: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The range of each name, and its counter in every row of the sketch of that range."""
    shard = (mix(names, 2) % np.uint64(shards)).astype(np.int32)
    return shard, [(mix(names, 3 + row) & np.uint64(SKETCH_WIDTH - 1)).astype(np.uint32) for row in range(SKETCH_ROWS)]


def _partition_sketches(shards: int):
    """Names to the non-zero counters of one partition: ``shard, row, places, counts``; counts end at 255."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        names = np.concatenate(held)
        shard, places = sketch_places(names, shards)
        rows: list[tuple] = []
        for row, place in enumerate(places):
            cells, counts = np.unique(shard.astype(np.int64) << 32 | place, return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            starts = runs(cells >> 32)
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                rows.append((int(cells[a] >> 32), row, (cells[a:b] & 0xFFFFFFFF).astype("<u4").tobytes(), counts[a:b].tobytes()))
        columns = list(zip(*rows))
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["shard", "row", "places", "counts"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            size += batch.num_rows
            if size >= _NAMES_AT_ONCE:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _estimate(shards: int):
    """Names of one range that its merged sketch estimates at two or more."""

    def run(names: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        own = names["name"].to_numpy(np.int64)
        sketch = np.zeros((SKETCH_ROWS, SKETCH_WIDTH), np.uint8)
        for row, places, counts in zip(parts["row"], parts["places"], parts["counts"]):
            at = np.frombuffer(places, "<u4")
            sketch[row, at] = np.minimum(sketch[row, at].astype(np.uint16) + np.frombuffer(counts, np.uint8), 255)
        _, places = sketch_places(own.view(np.uint64), shards)
        least = np.min([sketch[row, at] for row, at in enumerate(places)], axis=0) if len(own) else np.zeros(0)
        return pd.DataFrame({"name": own[least >= 2]})

    return run


def repeated_names(names: DataFrame, names_per_sketch: int = NAMES_PER_SKETCH) -> DataFrame:
    """``name`` of all ``names(name)`` rows that occur twice or more, and of a few that do not."""
    shards = max(1, names.count() // names_per_sketch)
    parts = names.mapInArrow(_partition_sketches(shards), "shard int, row int, places binary, counts binary")
    with_range = names.distinct().mapInArrow(_ranges(shards), "shard int, name long")
    both = with_range.groupBy("shard").cogroup(parts.groupBy("shard"))
    return both.applyInPandas(_estimate(shards), "name long")


def _ranges(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(sketch_places(names.view(np.uint64), shards)[0]), batch.column(0)], ["shard", "name"])

    return run


def _candidates(window: int, gram: int, out: T.StructType):
    """Suspects ``(doc_id, text_key, text, names)`` to rows for the windows with one of the names.

    A window that a smaller id of the same task has is ``later`` at once. The others go on to be grouped with those of other tasks, so a window travels once per task,
    not once per document.
    """

    def flush(held: list[tuple], ids: list[pa.Array], keys: list[pa.Array], target: pa.Schema) -> Iterator[pa.RecordBatch]:
        low, high, doc, start = (np.concatenate(x) for x in zip(*held))
        docs, text_keys = pa.concat_arrays(ids), pa.concat_arrays(keys)
        # equal ids have equal ranks, whatever their type is
        rank = pc.rank(docs, sort_keys="ascending", tiebreaker="dense").to_numpy().astype(np.int64)[doc]
        order = np.lexsort((rank, high, low))
        low, high, doc, start, rank = (x[order] for x in (low, high, doc, start, rank))
        groups = runs(low, high)
        later = rank > np.repeat(rank[groups[:-1]], np.diff(groups))
        for first in range(0, len(low), _ROWS_AT_ONCE):
            at = slice(first, first + _ROWS_AT_ONCE)
            own = pa.array(doc[at])
            columns = [pa.array(low[at]), pa.array(high[at]), docs.take(own), text_keys.take(own), pa.array(start[at]), pa.array(later[at])]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        held, ids, keys, size, before = [], [], [], 0, 0
        for batch in batches:
            ids.append(batch.column(0))
            keys.append(batch.column(1))
            texts = batch.column(2).cast(pa.binary())
            for i in range(batch.num_rows):
                low, high = _word_hashes(texts[i].as_py().split())
                wanted = np.array(batch.column(3)[i].as_py(), np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(window_names(low, window, gram), wanted))
                found = [rolling(h, window, b)[at].view(np.int64) for h, b in zip((low, high), BASES)]
                held.append((*found, np.full(len(at), before + i, np.int32), at.astype(np.int32)))
                size += len(at)
            before += batch.num_rows
            if size >= _WINDOWS_AT_ONCE:
                yield from flush(held, ids, keys, target)
                held, ids, keys, size, before = [], [], [], 0, 0
        if held:
            yield from flush(held, ids, keys, target)

    return run


def _later_windows(out: T.StructType):
    """Windows ``(low, high, doc_id, text_key, start)``, sorted by the first three, to ``(doc_id, text_key, start)`` of those that a smaller id has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        last, owner = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            low, high = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            groups = runs(low, high)
            docs = batch.column(2)
            firsts = docs.take(pa.array(np.repeat(groups[:-1], np.diff(groups))))
            other = pc.not_equal(docs, firsts)
            if last == (low[0], high[0]):
                # the window of the batch before goes on
                size = int(groups[1])
                other = pa.concat_arrays([pc.not_equal(docs[:size], owner), other[size:]])
            if last != (low[-1], high[-1]) or len(groups) > 2:
                owner = docs[int(groups[-2])]
            last = (low[-1], high[-1])
            found = pa.record_batch(batch.columns[2:5], schema=target).filter(other)
            yield found

    return run


def covered(starts: np.ndarray, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Which of ``n_words`` words lie in a window that begins at one of ``starts``."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges)[:n_words] > 0


def _without(window: int, out: T.StructType):
    """``(doc_id, text_key, text, starts)`` to the number of removed words and the words left."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            removed, kept = [], []
            for text, starts in zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                gone = covered(np.array(starts, np.int64), len(words), window)
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return run


def _texts_of(texts: DataFrame, some: DataFrame) -> DataFrame:
    """Texts that may belong to ``some`` rows: the others are dropped where they are read, before a join moves them."""
    bits = bits_for(some.count())
    return may_be_in(texts, "text_key", membership(some, "text_key", bits), bits)


def substring_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    names_per_sketch: int = NAMES_PER_SKETCH,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_key, n_words, n_removed, words_sha256, kept_text``.

    A word is removed when a window of ``window`` words around it also starts in a document with a smaller id; windows are judged on the
    input. ``kept_text`` holds the words left, joined by one space, and is null where nothing is removed; ``words_sha256`` (binary) is the
    hash of all words so joined; ``text_key`` is Spark's xxhash64 of the text, null counting as empty.

    Null and empty texts have no words. A null id is neither smaller nor larger than another, so such rows stay whole and remove nothing.
    Rows that repeat an id are the same document: they remove nothing from each other. An empty table gives no rows; other columns are ignored.
    """
    if not 0 < gram <= window:
        raise ValueError("a gram must not be longer than a window")
    kind = id_type(docs, id_col)
    key = [T.StructField("doc_id", kind), T.StructField("text_key", T.LongType())]
    texts = id_and_text(docs, id_col, text_col).select("doc_id", text_key().alias("text_key"), "text")

    profile = T.StructType([*key, T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("names", T.ArrayType(T.LongType()))])
    profiles = cut(texts.mapInArrow(_profile(window, gram, profile), profile), "profiles")
    groups = profiles.filter((F.col("n_words") >= window) & F.isnotnull("doc_id")).groupBy("digest")
    groups = cut(groups.agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"), "copies")
    profiles = cut(profiles.join(groups, "digest", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first"), "profiles")

    own = profiles.filter(~F.col("copy") & F.isnotnull("doc_id")).select("doc_id", "text_key", F.explode("names").alias("name"))
    repeated = cut(repeated_names(own.select("name"), names_per_sketch), "repeated")
    marked = own.join(repeated, "name").groupBy("doc_id", "text_key").agg(F.collect_set("name").alias("names"))
    marked = cut(marked, "marked")
    suspects = cut(_texts_of(texts, marked).join(marked, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "names"), "suspects")

    place = [*key, T.StructField("start", T.IntegerType())]
    found = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), *place, T.StructField("later", T.BooleanType())])
    windows = cut(suspects.mapInArrow(_candidates(window, gram, found), found), "windows")
    first = windows.filter(~F.col("later")).drop("later").repartition("low", "high").sortWithinPartitions("low", "high", "doc_id")
    later = windows.filter("later").select("doc_id", "text_key", "start")
    later = later.unionByName(first.mapInArrow(_later_windows(T.StructType(place)), T.StructType(place)))
    starts = cut(later.groupBy("doc_id", "text_key").agg(F.collect_set("start").alias("starts")), "starts")

    left = T.StructType([*key, T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    touched = _texts_of(suspects.drop("names"), starts).join(starts, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "starts")
    touched = cut(touched.mapInArrow(_without(window, left), left).dropDuplicates(["doc_id", "text_key"]), "touched")
    named = [profiles["doc_id"].eqNullSafe(touched["doc_id"]), profiles["text_key"] == touched["text_key"]]
    return profiles.join(touched, named, "left").select(
        profiles["doc_id"],
        profiles["text_key"],
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.col("digest").alias("words_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
