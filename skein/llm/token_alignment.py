"""Alignment of the tokens of two tokenizers over the same bytes, by skipping runs on a diagonal.

Both tokenizations of a text end at its last byte; the byte offsets where tokens of both end cut them into groups. Where the next tokens of both end
together, they are a group each, and the index into one list of ends is that into the other plus a shift. Such stretches are jumped: slices of the two
arrays of ends are compared at the shift, twice as long after each match, and shorter again after a mismatch. Where ends differ, the two lists are
walked token by token to the next common end, which gives the links of the group, and the shift is updated.

Documents are aligned in blocks. A block keeps its links as places in its own table of id pairs; only those tables are grouped over the corpus, and
what they get back is joined to the block.
"""

from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import id_and_text, id_type, runs, schema
from skein.llm.encoding import WordTable
from skein.llm.piece_codec import MARK, ChunkTable
from skein.session import cut

# Characters of the texts of a block, and of those that are aligned together within one.
BLOCK_BYTES = 1024 * 1024
ALIGNED_BYTES = 256 * 1024
# Distinct words that a worker keeps per tokenizer, in the newer of two generations.
WORDS_KEPT = 150_000
# Ends of a stretch that are compared one by one before slices are.
SINGLE_ENDS = 32


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A that end inside a token of B, and those tokens of B; then tokens of B that end inside a token of A, and those tokens of A.

    Both arrays of ends (64-bit) rise and have the same last value. All other tokens end a group.
    """
    a, b = ends_a.tolist(), ends_b.tolist()
    raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
    inner_a, around_a, inner_b, around_b = (array("q") for _ in range(4))
    add_a, add_around_a, add_b, add_around_b = inner_a.append, around_a.append, inner_b.append, around_b.append
    n = len(a)
    # past the end the two never agree
    a.append(-1)
    b.append(-2)
    i = shift = 0
    while i < n:
        # a stretch of groups of one token each: single ends first, then slices that double as long as they agree
        near = i + SINGLE_ENDS
        while i < near and a[i] == b[i + shift]:
            i += 1
        if i == near:
            step = SINGLE_ENDS
            while step:
                to = i + step
                if to <= n and raw_a[8 * i : 8 * to] == raw_b[8 * (i + shift) : 8 * (to + shift)]:
                    i, step = to, 2 * step
                else:
                    step //= 2
        if i == n:
            break
        # an irregular group: on to the next common end, one token at a time
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                add_a(i)
                add_around_a(j)
                i += 1
                x = a[i]
            else:
                add_b(j)
                add_around_b(i)
                j += 1
                y = b[j]
        i += 1
        shift = j + 1 - i
    return tuple(np.frombuffer(x, np.int64) for x in (inner_a, around_a, inner_b, around_b))


class Tokens:
    """Ids of texts by both tokenizers, and the bytes of every id."""

    def __init__(self, vocabulary: str, model: str) -> None:
        self.words = WordTable(vocabulary, WORDS_KEPT, names_as_text=True)
        self.chunks = ChunkTable(model, WORDS_KEPT)
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        tokenizer, pieces = self.words.tokenizer, self.chunks.pieces
        names = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size())]
        # a name with a character that stands for no byte is not byte-level: its bytes can match no text
        self.bytes_a = [bytes(byte[c] for c in n) if all(c in byte for c in n) else n.encode() + b"\0" for n in names]
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.widths_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.widths_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # an id with what follows it in the written form of groups
        self.written = [f"{i}{mark}" for i in range(max(len(self.bytes_a), len(self.bytes_b))) for mark in ",|;"]
        # with a token for every byte and nothing that rewrites a text, the bytes of A are always those of the text
        self.lossless = tokenizer.normalizer is None and {bytes([x]) for x in range(256)} <= set(self.bytes_a)

    def of(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids by both, none for texts that are empty or that the tokens do not spell byte by byte."""
        a = [np.frombuffer(x, "<u4") for x in self.words.ids([" " + t for t in texts])]
        b = [np.frombuffer(x, "<i4") for x in self.chunks.encode(texts)]
        none = np.zeros(0, np.uint32)
        changed = self.chunks.changed
        for i, text in enumerate(texts):
            size = len(text.encode()) + 1
            same = text and MARK not in text and not (changed and not changed.keys().isdisjoint(self.chunks.words(text)))
            same = same and self.widths_a[a[i]].sum() == size and self.widths_b[b[i]].sum() == size
            if not same or not (self.lossless or b"".join(map(self.bytes_a.__getitem__, a[i].tolist())) == b" " + text.encode()):
                a[i] = b[i] = none
        return a, b


@functools.lru_cache(maxsize=1)
def tokens(vocabulary: str, model: str) -> Tokens:
    """The tables of this Python worker, which later tasks of the worker go on with."""
    return Tokens(vocabulary, model)


def _joined(parts: list) -> np.ndarray:
    return np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int64)


class Aligned:
    """The alignment of several texts, aligned as one sequence: the last end of a text is common to both."""

    def __init__(self, known: Tokens, texts: list[str]) -> None:
        self.known = known
        a, b = known.of(texts)
        self.a, self.b = _joined(a), _joined(b)
        self.ends_a = np.cumsum([0, *map(len, a)])
        self.ends_b = np.cumsum([0, *map(len, b)])
        inner_a, around_a, inner_b, around_b = align(np.cumsum(known.widths_a[self.a]), np.cumsum(known.widths_b[self.b]))
        # of each group, the number of tokens up to its end
        self.groups_a, self.groups_b = (_others(inner, len(x)) for inner, x in ((inner_a, self.a), (inner_b, self.b)))
        # a token has a link for each token of the other side that ends inside it, and one more; a link is its two ids as one number
        links_of_a = np.bincount(around_b, minlength=len(self.a)) + 1
        links_of_b = np.bincount(around_a, minlength=len(self.b)) + 1
        self.pairs = np.repeat(self.a * len(known.bytes_b), links_of_a) + np.repeat(self.b, links_of_b)
        # of each text, the groups and the links up to its end
        self.ends_groups = np.searchsorted(self.groups_a, self.ends_a, "right")
        self.ends_links = np.concatenate([[0], np.cumsum(links_of_a)])[self.ends_a]

    def written(self) -> list[str]:
        """Groups of each text as ``a1,a2|b1;a3|b2,b3``."""
        firsts_a, firsts_b = (np.concatenate([[0], x])[:-1] for x in (self.groups_a, self.groups_b))
        sizes_a, sizes_b = self.groups_a - firsts_a, self.groups_b - firsts_b
        # a group of two tokens is one piece of text, any other has a piece for each token
        codes, distinct = pd.factorize(self.a[firsts_a] * len(self.known.bytes_b) + self.b[firsts_b])
        pieces = [f"{a}|{b};" for a, b in zip(*(x.tolist() for x in divmod(distinct, len(self.known.bytes_b))))]
        several = np.flatnonzero((sizes_a > 1) | (sizes_b > 1))
        sizes = np.ones(len(codes), np.int64)
        sizes[several] = sizes_a[several] + sizes_b[several]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        order = np.repeat(codes, sizes)
        at = ends[several]
        for ids, first, size, mark in ((self.a, firsts_a, sizes_a, 1), (self.b, firsts_b, sizes_b, 2)):
            first, size = first[several], size[several]
            marked = len(pieces) + 3 * ids[_ranges(first, size)]
            marked[np.cumsum(size) - 1] += mark
            order[_ranges(at, size)] = marked
            at = at + size
        parts = list(map((pieces + self.known.written).__getitem__, order.tolist()))
        ends = ends[self.ends_groups].tolist()
        return ["".join(parts[first:last])[:-1] for first, last in zip(ends, ends[1:])]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``sizes`` numbers from each of ``starts`` on, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _others(inner: np.ndarray, n: int) -> np.ndarray:
    """One more than each place below ``n`` that is not an inner one."""
    last = np.ones(n, bool)
    last[inner] = False
    return np.flatnonzero(last) + 1


def _parts(texts: list[str], most: int) -> Iterator[slice]:
    """Neighbouring texts of at most ``most`` characters together, or a longer one alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > most:
            yield slice(first, i)
            first, size = i, 0
        size += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def aligned_groups(
    docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, a, b, groups_a, groups_b`` for every row: the ids of a space and the text by the byte-level ``vocabulary`` (A), those of the text by the
    SentencePiece ``model`` (B), and the number of tokens of each up to the end of every group.

    Texts that are null, empty or not spelled by the bytes of both have empty lists. Rows that repeat an id are aligned each; an empty table gives no rows;
    other columns are ignored.
    """
    out = schema(docs, id_col, a="array<int>", b="array<int>", groups_a="array<int>", groups_b="array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _parts(texts, ALIGNED_BYTES):
                one = Aligned(tokens(vocabulary, model), texts[part])
                lists = [_lists(one.a, one.ends_a), _lists(one.b, one.ends_b)]
                lists += [
                    _lists(groups - np.repeat(ends[:-1], np.diff(one.ends_groups)), one.ends_groups)
                    for groups, ends in ((one.groups_a, one.ends_a), (one.groups_b, one.ends_b))
                ]
                yield pa.record_batch([batch.column(0)[part], *lists], out.names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, out)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))


def _block(number: int, ids: pa.Array, texts: list[str], known: Tokens) -> list[pa.Array]:
    counts, written, pairs = [], [], []
    for part in _parts(texts, ALIGNED_BYTES):
        one = Aligned(known, texts[part])
        counts.append(np.stack([np.diff(x) for x in (one.ends_a, one.ends_b, one.ends_groups, one.ends_links)]))
        written += [hashlib.sha256(w.encode()).hexdigest() if w else "" for w in one.written()]
        pairs.append(one.pairs)
    codes, distinct = pd.factorize(_joined(pairs))
    order = np.argsort(distinct)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    links, times, distinct = place[codes], np.bincount(codes, minlength=len(order))[order], distinct[order]
    n_a, n_b, n_groups, n_links = np.concatenate(counts, axis=1).astype("<i8")
    columns = [n_a, n_b, n_groups, n_links, links.astype(_place_type(len(distinct))), distinct.astype("<i8"), times.astype("<i8")]
    whole = pa.array([0, len(ids)], pa.int32())
    return [
        pa.array([number], pa.int64()), pa.ListArray.from_arrays(whole, ids), pa.ListArray.from_arrays(whole, pa.array(written, pa.string())),
        *[pa.array([c.tobytes()], pa.binary()) for c in columns],
    ]


def _place_type(n: int) -> str:
    """Places below ``n`` in as few bytes as numpy has."""
    return "<u2" if n <= 1 << 16 else "<u4"


def _blocks(vocabulary: str, model: str, out: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        # numbers are the same when a task runs again
        number = TaskContext.get().partitionId() << 32
        target = to_arrow_schema(out)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _parts(texts, BLOCK_BYTES):
                ids = batch.column(0)[part]
                columns = _block(number, pa.concat_arrays([ids]), texts[part], tokens(vocabulary, model))
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, target)], schema=target)
                number += 1

    return run


def _pair_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(block, pairs, times)`` to a row for every pair."""
    for batch in batches:
        for block, pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            pairs, times = np.frombuffer(pairs, "<i8"), np.frombuffer(times, "<i8")
            yield pa.record_batch([pa.array(np.full(len(pairs), block)), pa.array(pairs), pa.array(times)], ["block", "pair", "n"])


def _tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ``(block, pair, n, best)`` to one row for every block, with the counts and marks in the order of its pairs."""
    block, held = None, []

    def table() -> pa.RecordBatch:
        n, best = (np.concatenate(x) for x in zip(*held))
        columns = [pa.array([block], pa.int64()), pa.array([n.astype("<i8").tobytes()]), pa.array([best.astype(bool).tobytes()])]
        return pa.record_batch(columns, ["block", "counts", "bests"])

    for batch in batches:
        blocks, n, best = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
        starts = runs(blocks)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            if blocks[a] != block:
                if held:
                    yield table()
                block, held = int(blocks[a]), []
            held.append((n[a:b], best[a:b]))
    if held:
        yield table()


def _documents(out: T.StructType):
    """A block and its table to its documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(out)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
                n_a, n_b, n_groups, n_links = (np.frombuffer(row[x].as_py(), "<i8") for x in ("n_a", "n_b", "n_groups", "n_links"))
                counts = np.frombuffer(row["counts"].as_py() or b"", "<i8")
                links = np.frombuffer(row["links"].as_py(), _place_type(len(counts)))
                bests = np.frombuffer(row["bests"].as_py() or b"", bool)
                ends = np.cumsum(n_links)
                sums = [np.concatenate([[0], np.cumsum(x[links], dtype=np.int64)]) for x in (bests, counts)]
                n_best, count_sum = (s[ends] - s[ends - n_links] for s in sums)
                columns = [row["ids"].values, *map(pa.array, (n_a, n_b, n_groups, n_links, n_best, count_sum)), row["written"].values]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    return run


def alignment_counts(
    docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Two tables: per row of ``docs`` what its alignment holds, and the links of the whole corpus.

    The first has ``doc_id, n_a, n_b, n_groups, n_links``, ``n_best`` (links whose pair of ids is linked most often of all pairs with their id of B, ties
    included), ``count_sum`` (corpus-wide counts of the pairs of all links) and ``groups_sha256``; the second ``a_id, b_id, n``. A and B, and the
    rows that have no tokens (their numbers are 0, their hash is empty), are those of ``aligned_groups``.
    """
    kind = id_type(docs, id_col)
    binaries = ["n_a", "n_b", "n_groups", "n_links", "links", "pairs", "times"]
    packed = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("written", T.ArrayType(T.StringType())),
        *[T.StructField(name, T.BinaryType()) for name in binaries],
    ])
    texts = id_and_text(docs, id_col, text_col)
    blocks = cut(texts.mapInArrow(_blocks(vocabulary, model, packed), packed), "aligned")

    met = blocks.select("block", "pairs", "times").mapInArrow(_pair_rows, "block long, pair long, n long")
    size_b = _piece_count(model)
    totals = cut(met.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    most = totals.groupBy(F.pmod("pair", F.lit(size_b)).alias("b_id")).agg(F.max("n").alias("most"))
    marked = totals.join(most, F.pmod("pair", F.lit(size_b)) == F.col("b_id")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    marked = cut(marked, "marked-pairs")
    back = met.select("block", "pair").join(marked, "pair").select("block", "pair", "n", "best")
    tables = back.repartition("block").sortWithinPartitions("block", "pair").mapInArrow(_tables, "block long, counts binary, bests binary")
    tables = cut(tables, "block-tables")

    out = schema(
        docs, id_col, n_a="long", n_b="long", n_groups="long", n_links="long", n_best="long", count_sum="long", groups_sha256="string"
    )
    joined = blocks.drop("pairs", "times").join(tables, "block", "left")
    links = totals.select((F.col("pair") / size_b).cast("long").cast("int").alias("a_id"), F.pmod("pair", F.lit(size_b)).cast("int").alias("b_id"), "n")
    return joined.mapInArrow(_documents(out), out), links


@functools.lru_cache(maxsize=4)
def _piece_count(model: str) -> int:
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model).get_piece_size()
