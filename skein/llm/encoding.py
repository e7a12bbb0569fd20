"""Byte-level BPE ids of whole texts, with every word of a task encoded once.

The splitting pattern of byte-level BPE starts a new piece at a space unless white space stands on both of its sides
or the text ends there, so a text can be cut before its spaces and the parts encoded apart. Parts repeat, so a task keeps
the ids of those it has met. A text where a cut would not be safe is encoded whole.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import arrow_batches, id_and_text, schema

# A space that may lie inside a piece: white space before it, and white space or the end after it.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")

# Parts of printable ASCII and the letters from U+00C0 to U+017F, and the pieces that the splitting pattern makes of them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_PLAIN = re.compile(rf"[\x21-\x7e{_LETTERS}]+")
_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+"

END_ID = 0


def _ranked_merges(tokenizer):
    """An encoder of plain parts by the ranks of their merges, several times as fast as the general one.

    It gives the same ids where the ids of the vocabulary grow with the order of the merges; else there is none.
    """
    import tiktoken

    model = json.loads(tokenizer.to_str())["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    if made != sorted(set(made)) or model.get("ignore_merges") or model.get("dropout"):
        return None
    # printable bytes name themselves in a byte-level vocabulary, the others are named by the characters from 256 on
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    single = {n: i for n, i in vocabulary.items() if len(n) == 1 and n in byte}
    if len(single) != 256 or max(single.values()) > min(made, default=256):
        return None
    ranks = {bytes([byte[n]]): i for n, i in single.items()}
    ranks |= {bytes(byte[c] for c in a + b): vocabulary[a + b] for a, b in merges}
    return tiktoken.Encoding("plain", pat_str=_PIECES, mergeable_ranks=ranks, special_tokens={})


class WordTable(dict):
    """Ids (little-endian unsigned 32-bit) of parts with a space before them.

    When it holds ``limit`` parts it becomes the older generation and a new one begins, so parts that come often stay. Texts that hold the name of
    an added token, such as an end mark, go whole to the library, which gives that token's id; with ``names_as_text`` such names are ordinary text.
    """

    def __init__(self, vocabulary: str, limit: int = 350_000, names_as_text: bool = False) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.limit = limit
        self.older: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(vocabulary)
        added = [] if names_as_text else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True  # parts hold no such name, joined parts must not make one
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.widths = np.array([len(name or "") for name in names])  # a character of a byte-level name is one byte
        self.merges = _ranked_merges(self.tokenizer)

    def encode(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def add(self, parts: set[str]) -> None:
        new = parts.difference(self)
        if len(self) + len(new) > self.limit:
            self.older = dict(self)
            self.clear()
            new = parts
        known = {p: self.older[p] for p in new if p in self.older}
        self.update(known)
        new = new.difference(known)
        plain = [p for p in new if _PLAIN.fullmatch(p)] if self.merges else []
        self.split(plain, lambda text: self.merges.encode_ordinary(text))
        # parts with white space at an end would meet that of their neighbours
        others = new.difference(plain)
        alone = [p for p in others if not p or p[0].isspace() or p[-1].isspace()]
        self.update(zip(alone, self.encode([" " + p for p in alone]), strict=True))
        self.split(list(others.difference(alone)), lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids)

    def split(self, parts: list[str], encode: Callable[[str], list[int]]) -> None:
        """Encode many parts as one text and tell their ids apart by the bytes that each id stands for."""
        for start in range(0, len(parts), 20_000):
            some = parts[start : start + 20_000]
            ids = np.array(encode(" " + " ".join(some)), "<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in some])
            cuts = np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1
            flat, cuts = ids.tobytes(), (4 * np.concatenate(([0], cuts))).tolist()
            self.update(zip(some, [flat[a:b] for a, b in zip(cuts, cuts[1:])], strict=True))

    def ids(self, texts: list[str], group: int = 512) -> list[bytes]:
        """The ids of every text, in order."""
        out: list[bytes] = []
        for start in range(0, len(texts), group):
            some = texts[start : start + group]
            parts = [None if _UNSAFE.search(t) else t.split(" ") for t in some]
            named = {i for i, t in enumerate(some) if self.added.search(t)} if self.added else ()
            for i in named:
                some[i], parts[i] = "", None
            self.add(set().union(*[words[1:] for words in parts if words]))
            first = self.encode([t if words is None else words[0] for t, words in zip(some, parts, strict=True)])
            for i in named:
                first[i] = np.array(self.whole.encode(texts[start + i], add_special_tokens=False).ids, "<u4").tobytes()
            for head, words in zip(first, parts, strict=True):
                out.append(head if words is None else head + b"".join(map(self.__getitem__, words[1:])))
        return out


@functools.lru_cache(maxsize=2)
def word_table(vocabulary: str) -> WordTable:
    """The table of this Python worker, which later tasks of the worker go on with."""
    return WordTable(vocabulary)


def encode_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the ids of every whole text and then ``END_ID``, as little-endian unsigned 32-bit numbers in a binary.

    Ids are those of the library as it is loaded: the name of a special token in a text gives the id of that token. Null and empty texts have the end id only; rows
    that repeat an id are encoded each; an empty table gives no rows; other columns are ignored.
    """
    out = schema(docs, id_col, ids="binary")
    end = np.array([END_ID], "<u4").tobytes()

    def rows(ids: pa.Array, texts: list[str]) -> tuple:
        return ids, [coded + end for coded in word_table(vocabulary).ids(texts)]

    return id_and_text(docs, id_col, text_col).mapInArrow(arrow_batches(rows, out), out)
