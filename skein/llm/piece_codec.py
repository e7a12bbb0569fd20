"""SentencePiece encoding and decoding of whole texts through a table of distinct marked words.

No piece of the vocabulary continues over a white-space marker (this is checked when the model is loaded), so a text may be
cut before each run of spaces. Each distinct marked word of a batch is segmented once by the library; the ids of
a text are those of its words joined by position, and so is the text decoded from them.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import arrow_batches, id_and_text, schema

MARK = "▁"
_CROSSING = re.compile(f"[^{MARK}]{MARK}")
_ODD_SPACES = re.compile(r"  |\A | \Z")
_CHUNK = re.compile(r" +[^ ]+| +\Z")
# Words that go through the library in one text.
TOGETHER = 256


class ChunkTable:
    """Segments of marked words: their ids (little-endian 32-bit) by word, and what ids decode to where that is not the word.

    A word is kept without the marker in front of it. When the table holds ``limit`` words it becomes the older generation and a
    new one begins, so words that come often stay.
    """

    def __init__(self, model: str, limit: int = 350_000) -> None:
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=model)
        self.limit = limit
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.changed: dict[str, str] = {}
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        for i, name in enumerate(names):
            if _CROSSING.search(name):
                raise ValueError(f"piece {i} crosses a white-space marker, so words cannot be segmented apart")
        self.marked = np.array([name.startswith(MARK) for name in names])
        self.mark = self.pieces.piece_to_id(MARK)

    def add(self, words: set[str]) -> None:
        new = words.difference(self.ids)
        if len(self.ids) + len(new) > self.limit:
            self.older, self.ids = self.ids, {}
            new = words
        known = {w: self.older[w] for w in new if w in self.older}
        self.ids.update(known)
        new = list(new.difference(known))
        odd = [w for w in new if not w or " " in w]
        # the library puts the marker in front of a text, but gives nothing at all for an empty one
        self.keep(odd, [ids if w else [self.mark] for w, ids in zip(odd, self.pieces.encode(odd, num_threads=1), strict=True)])
        plain = [w for w in new if w and " " not in w]
        for start in range(0, len(plain), TOGETHER):
            some = plain[start : start + TOGETHER]
            ids = np.array(self.pieces.encode(" ".join(some)), "<i4")
            # a word begins where a piece begins with the marker
            cuts = [*(4 * np.flatnonzero(self.marked[ids])).tolist(), 4 * len(ids)]
            flat = ids.tobytes()
            self.ids.update(zip(some, [flat[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))
            decoded = self.pieces.decode(ids.tolist()).split(" ")
            if decoded != some:
                self.changed.update({w: d for w, d in zip(some, decoded, strict=True) if w != d})

    def keep(self, words: list[str], segments: list[list[int]]) -> None:
        for word, ids in zip(words, segments, strict=True):
            self.ids[word] = np.array(ids, "<i4").tobytes()
            decoded = self.pieces.decode(ids)
            if decoded != word:
                self.changed[word] = decoded

    @staticmethod
    def words(text: str) -> list[str]:
        text = text.replace(MARK, " ")
        if not text:
            return []
        if _ODD_SPACES.search(text):
            return [chunk[1:] for chunk in _CHUNK.findall(" " + text)]
        return text.split(" ")

    def encode(self, texts: list[str], group: int = 512) -> list[bytes]:
        """The ids of every text."""
        ids: list[bytes] = []
        for start in range(0, len(texts), group):
            some = [self.words(t) for t in texts[start : start + group]]
            self.add(set().union(*some))
            ids += [b"".join(map(self.ids.__getitem__, words)) for words in some]
        return ids

    def encode_and_decode(self, texts: list[str], group: int = 512) -> tuple[list[bytes], list[str]]:
        """The ids of every text, and the text that those ids decode to."""
        ids: list[bytes] = []
        decoded: list[str] = []
        for start in range(0, len(texts), group):
            some = [self.words(t) for t in texts[start : start + group]]
            self.add(set().union(*some))
            ids += [b"".join(map(self.ids.__getitem__, words)) for words in some]
            changed = self.changed
            decoded += [" ".join([changed.get(w, w) for w in words] if changed else words) for words in some]
        return ids, decoded


def id_lists(coded: list[bytes]) -> pa.ListArray:
    """Arrow lists of 32-bit ids from the bytes of each."""
    ends = np.cumsum([0, *map(len, coded)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))


@functools.lru_cache(maxsize=2)
def chunk_table(model: str) -> ChunkTable:
    """The table of this Python worker, which later tasks of the worker go on with."""
    return ChunkTable(model)


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """``doc_id, ids array<int>`` and, with ``decode``, the ``decoded`` text, one row per row of ``docs``.

    The ids are those of the library without begin and end ids. A null text counts as empty and has no ids; an empty table gives
    no rows; rows that repeat an id are encoded each; other columns are ignored. Texts stay in the tasks that read them.
    """
    out = schema(docs, id_col, ids="array<int>", **({"decoded": "string"} if decode else {}))

    def rows(ids: pa.Array, texts: list[str]) -> tuple:
        coded, decoded = chunk_table(model).encode_and_decode(texts)
        return (ids, id_lists(coded), decoded) if decode else (ids, id_lists(coded))

    return id_and_text(docs, id_col, text_col).mapInArrow(arrow_batches(rows, out), out)


def decode_pieces(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded``: what the library decodes from the ids of every row; null ids decode to an empty text."""
    out = schema(encoded, id_col, decoded="string")

    def rows(ids: pa.Array, coded: list[list[int]]) -> tuple:
        return ids, chunk_table(model).pieces.decode(coded, num_threads=1) if coded else []

    lists = F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>"))
    return encoded.select(F.col(id_col).alias("doc_id"), lists.alias("ids")).mapInArrow(arrow_batches(rows, out), out)
