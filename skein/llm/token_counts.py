"""Token counts of a unigram tokenizer, by dynamic programming shared over a trie of distinct words.

The best score of a word's prefix depends on the prefix alone. So the distinct words of a task go into a trie, each node gets
its forward score once, however many words share it, and the node where a word ends keeps the token count of the word.
"""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.common import arrow_batches, id_and_text, schema

MARK = "▁"
UNKNOWN_PENALTY = 10.0
# Bytes of the longest words that go into the trie.
LONG_WORD = 1000
NO_END = object()


class Unigram:
    """Pieces with scores, and what a character outside the vocabulary costs."""

    def __init__(self, scores: dict[str, float]) -> None:
        self.scores = scores
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        # every end of a piece, with the score of those that are pieces: what is not in here ends no longer piece either
        self.ends: dict[str, float | None] = {piece[at:]: None for piece in scores for at in range(1, len(piece))}
        self.ends.update(scores)

    @classmethod
    def from_vocabulary(cls, model: str) -> Unigram:
        """The ordinary pieces of a SentencePiece model, with Zipf's law over their order as probabilities."""
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_file=model)
        ordinary = [
            pieces.id_to_piece(i)
            for i in range(pieces.get_piece_size())
            if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))
        ]
        total = math.log(sum(1 / rank for rank in range(1, len(ordinary) + 1)))
        return cls({piece: -math.log(rank) - total for rank, piece in enumerate(ordinary, 1)})

    def count(self, word: str) -> int:
        """The tokens that ``Trie.insert`` finds, with no more memory than the longest piece needs."""
        reach = max(map(len, self.ends), default=1) + 1
        score, tokens = [0.0] * reach, [0] * reach
        for end, char in enumerate(word, 1):
            last = (end - 1) % reach
            best, fewest = score[last] + self.unknown, tokens[last] + len(char.encode())
            for start in range(end - 1, -1, -1):
                piece = self.ends.get(word[start:end], NO_END)
                if piece is NO_END:
                    break
                if piece is not None:
                    before = start % reach
                    total, n = score[before] + piece, tokens[before] + 1
                    if total > best or total == best and n < fewest:
                        best, fewest = total, n
            score[end % reach], tokens[end % reach] = best, fewest
        return tokens[len(word) % reach]


class Trie:
    """Words in a trie of code points; node 0 is the empty prefix."""

    def __init__(self, model: Unigram) -> None:
        self.model = model
        self.children: dict[tuple[int, str], int] = {}
        self.score = [0.0]
        self.tokens = [0]

    def insert(self, word: str) -> int:
        """Add ``word`` and return the tokens of its best segmentation: the highest score, then the fewest tokens.

        A character outside the vocabulary stands for its UTF-8 bytes, one token each.
        """
        model, children, score, tokens = self.model, self.children, self.score, self.tokens
        path = [0]
        for end, char in enumerate(word, 1):
            parent = path[-1]
            node = children.get((parent, char))
            if node is None:
                best, fewest = score[parent] + model.unknown, tokens[parent] + len(char.encode())
                for start in range(end - 1, -1, -1):
                    piece = model.ends.get(word[start:end], NO_END)
                    if piece is NO_END:
                        break
                    if piece is not None:
                        before = path[start]
                        total, n = score[before] + piece, tokens[before] + 1
                        if total > best or total == best and n < fewest:
                            best, fewest = total, n
                node = children[parent, char] = len(score)
                score.append(best)
                tokens.append(fewest)
            path.append(node)
        return tokens[path[-1]]


class CountTable(dict):
    """Token counts by word (UTF-8 bytes); trie and counts start anew at ``limit`` nodes or words.

    Words of more than ``LONG_WORD`` bytes share no prefix worth keeping: they are counted one by one and not kept.
    """

    def __init__(self, model: Unigram, limit: int = 1_000_000) -> None:
        super().__init__()
        self.limit = limit
        self.trie = Trie(model)

    def add(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if max(len(self) + len(new), len(self.trie.score)) > self.limit:
            self.clear()
            self.trie = Trie(self.trie.model)
            new = list(words)
        for word in sorted(new):
            self[word] = self.trie.insert(MARK + word.decode())

    def __missing__(self, word: bytes) -> int:
        return self.trie.model.count(MARK + word.decode())

    def counts(self, texts: list[bytes], group: int = 512) -> tuple[list[int], list[int]]:
        """Words and tokens of every text."""
        n_words: list[int] = []
        n_tokens: list[int] = []
        for start in range(0, len(texts), group):
            some = [t.split() for t in texts[start : start + group]]
            self.add({w for words in some for w in words if len(w) <= LONG_WORD})
            n_words += map(len, some)
            n_tokens += [sum(map(self.__getitem__, words)) for words in some]
        return n_words, n_tokens


@functools.lru_cache(maxsize=2)
def count_table(model: str) -> CountTable:
    """The table of this Python worker, which later tasks of the worker go on with."""
    return CountTable(Unigram.from_vocabulary(model))


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens``, one row per row of ``docs``.

    Words are what stands between the white-space characters 9 to 13 and 32; each is counted with a marker in front. Null and
    empty texts have no words and no tokens. An empty table gives no rows; rows that repeat an id are counted each;
    other columns are ignored.
    """
    out = schema(docs, id_col, n_words="long", n_tokens="long")

    def rows(ids: pa.Array, texts: list[bytes]) -> tuple:
        return (ids, *count_table(model).counts(texts))

    return id_and_text(docs, id_col, text_col).mapInArrow(arrow_batches(rows, out, as_bytes=True), out)
