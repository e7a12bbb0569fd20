"""Encoding, token files, packing and token counts against the libraries and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from skein.llm.encoding import WordTable, encode_tokens
from skein.llm.packing import best_fit, cut_lengths, match_rounds
from skein.llm.piece_codec import ChunkTable, decode_pieces, encode_pieces, id_lists
from skein.llm.queries import QUERIES, tokenizer_file
from skein.llm.token_counts import CountTable, Trie, Unigram, token_counts
from skein.llm.token_files import id_width, pack_bits, read_tokens, unpack_bits, write_tokens
from tests.llm.helpers import SF, TEXTS, empty_documents, odd_documents, plain, words

BPE = tokenizer_file("byte_bpe_50k.json")
PIECES = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PIECES)


def random_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice("ab \n\t é1'!▁ 漢#") for _ in range(rng.randint(0, 14))) for _ in range(n)]


def ids_of(tokenizer, text) -> list[int]:
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_word_table_is_the_tokenizer(tokenizer):
    texts = [t or "" for t in TEXTS] + random_texts(5000)
    table = WordTable(BPE, limit=500)  # emptied many times
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert table.ids(texts, group=64) == want


def test_chunk_table_is_the_library(library):
    texts = [t or "" for t in TEXTS] + random_texts(5000)
    ids, decoded = ChunkTable(PIECES, limit=500).encode_and_decode(texts)
    want = library.encode(texts)
    assert id_lists(ids).to_pylist() == want
    assert decoded == library.decode(want)


def test_piece_codec(spark, library):
    docs = odd_documents(spark)
    coded = encode_pieces(docs, PIECES)
    want = [(r.doc_id, library.encode(r.text or "")) for r in docs.collect()]
    assert plain(coded.select("doc_id", "ids")) == sorted(want, key=repr)
    assert plain(coded.select("doc_id", "decoded")) == plain(decode_pieces(coded, PIECES))
    assert encode_pieces(empty_documents(spark), PIECES).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = []
    for r in docs:
        ids = library.encode(r.text)
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert plain(QUERIES["op5_piece_codec"](spark, SF)) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    packed = pack_bits(ids, width)
    assert len(packed) == (1001 * width + 7) // 8
    for first, count in ((0, 1001), (0, 0), (7, 1), (500, 501), (1000, 1)):
        assert (unpack_bits(packed, width, first, count) == ids[first : first + count]).all()


def test_id_width():
    assert [id_width(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


@pytest.mark.parametrize("vocabulary_size", [50_257, 100_000])
def test_token_files_round_trip(spark, tokenizer, tmp_path, vocabulary_size):
    docs = odd_documents(spark)
    write_tokens(docs, f"{tmp_path}/f", BPE, vocabulary_size, ids_per_block=100)
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = ids_of(tokenizer, r.text)
        want.append((r.doc_id, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [tuple(r) for r in read_tokens(spark, f"{tmp_path}/f").orderBy("start").collect()] == want
    asked = spark.createDataFrame([(7,), (21,), (None,), (999,)], "id long")
    some = read_tokens(spark, f"{tmp_path}/f", asked)
    assert plain(some) == sorted([w for w in want if w[0] in (7, 21, None)], key=repr)


def test_token_files_of_nothing(spark, tmp_path):
    write_tokens(empty_documents(spark), f"{tmp_path}/f", BPE, 50_257)
    assert read_tokens(spark, f"{tmp_path}/f").count() == 0


def test_token_file_query(spark, tokenizer):
    want, start = [], 0
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = ids_of(tokenizer, r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert plain(QUERIES["op8_token_files"](spark, SF)) == sorted(want, key=repr)


def decreasing_best_fit(lengths: list[int], size: int) -> int:
    gaps: list[int] = []
    for length in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is not None:
            gaps.remove(fit)
        gaps.append((size if fit is None else fit) - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_match_rounds_are_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    size = [7, 64, 100, 100, 2048, 1][seed]
    lengths = rng.integers(1, size + 1, 400)
    matches, bins = match_rounds(np.bincount(lengths, minlength=size + 1), size)
    fill: dict[int, int] = {}
    for length, _, n, first, offset in matches:
        for b in range(first, first + n):
            assert fill.get(b, 0) == offset
            fill[b] = offset + length
    assert max(fill.values()) <= size and sum(fill.values()) == lengths.sum()
    assert len(fill) == bins == decreasing_best_fit(lengths.tolist(), size)


def check_places(rows, size):
    by_bin: dict[int, list] = {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by_bin)


def test_best_fit_places_every_row(spark):
    rows = [(i % 90, i % 3, int(1 + (i * i) % 50), "x") for i in range(500)]
    df = spark.createDataFrame(rows + rows[:5], "doc_id long, piece int, length long, offset_note string")
    placed = best_fit(df, 50)
    assert plain(placed.select(df.columns)) == plain(df)
    assert check_places(placed.collect(), 50) == decreasing_best_fit([r[2] for r in rows + rows[:5]], 50)
    odd = spark.createDataFrame([(None, 0, 5), (1, 0, 0), (2, 0, None)], "doc_id long, piece int, length long")
    assert plain(best_fit(odd, 8)) == sorted([(None, 0, 5, 0, 0), (1, 0, 0, None, None), (2, 0, None, None, None)], key=repr)
    assert best_fit(odd.limit(0), 8).count() == 0
    with pytest.raises(ValueError):
        best_fit(df, 20)


def test_cut_lengths(spark):
    df = spark.range(0, 23).select("id", cut_lengths("id", 5).alias("p"))
    for r in df.collect():
        assert sum(x.length for x in r.p) == r.id and [x.piece for x in r.p] == list(range(len(r.p)))
        assert all(x.length == 5 for x in r.p[1:]) and all(0 < x.length <= 5 for x in r.p)
        assert [x.start for x in r.p] == [sum(y.length for y in r.p[:i]) for i in range(len(r.p))]


def test_packing_query(spark, tokenizer):
    placed = QUERIES["op7_best_fit_packing"](spark, SF).collect()
    ids = {r.doc_id: ids_of(tokenizer, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    by_doc: dict[int, list] = {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for doc, own in by_doc.items():
        assert sum(r.length for r in own) == len(ids[doc])
        assert len(own) == -(-len(ids[doc]) // 2048)
    assert by_doc.keys() == ids.keys()
    bins = check_places(placed, 2048)
    assert bins == decreasing_best_fit([r.length for r in placed], 2048)


def test_encode_tokens(spark, tokenizer):
    docs = odd_documents(spark)
    want = [(r.doc_id, np.array(ids_of(tokenizer, r.text), "<u4").tobytes()) for r in docs.collect()]
    assert plain(encode_tokens(docs, BPE)) == sorted(want, key=repr)


def best_segmentation(word: str, model: Unigram) -> int:
    """By trying every piece at every place, from the end backwards."""
    best = {len(word): (0.0, 0)}
    for i in range(len(word) - 1, -1, -1):
        options = [(best[i + 1][0] + model.unknown, -(len(word[i].encode()) - best[i + 1][1]))]
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in model.scores:
                options.append((best[j][0] + model.scores[word[i:j]], best[j][1] - 1))
        best[i] = max(options)
    return -best[0][1]


def test_trie_counts_are_the_best_segmentations():
    # scores that are sums of powers of two, so that both orders of adding agree
    model = Unigram({"a": -4.0, "b": -4.0, "ab": -6.0, "ba": -7.5, "aba": -8.0, "▁": -1.0, "▁a": -4.5, "bb": -8.0})
    rng = random.Random(3)
    trie = Trie(model)
    for _ in range(3000):
        word = "▁" + "".join(rng.choice("abé漢") for _ in range(rng.randint(0, 9)))
        assert trie.insert(word) == best_segmentation(word, model), word
    assert len(trie.score) < 3000 * 6  # prefixes are shared


def test_count_table_starts_anew():
    model = Unigram.from_vocabulary(PIECES)
    texts = [(t or "").encode() for t in TEXTS[:-5]]
    assert CountTable(model, limit=5).counts(texts, group=3) == CountTable(model).counts(texts)


def test_token_counts(spark):
    model = Unigram.from_vocabulary(PIECES)
    memo: dict[str, int] = {}

    def count(text):
        for w in words(text):
            if w not in memo:
                memo[w] = best_segmentation("▁" + w, model)
        return sum(memo[w] for w in words(text))

    docs = odd_documents(spark)
    docs = docs.filter("text is null or length(text) < 10000")
    want = [(r.doc_id, len(words(r.text)), count(r.text)) for r in docs.collect()]
    assert plain(token_counts(docs, PIECES)) == sorted(want, key=repr)
    assert token_counts(empty_documents(spark), PIECES).count() == 0
    want = [(r.doc_id, len(words(r.text)), count(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert plain(QUERIES["op1_token_counts"](spark, SF)) == sorted(want, key=repr)


def test_best_fit_replaces_and_keeps_columns(spark):
    rows = [(i, 0, 1 + i % 7, "clash") for i in range(50)]
    for name in ("sequence_id", "offset", "_rank", "_before", "_salt", "_n"):
        pieces = spark.createDataFrame(rows, f"doc_id long, piece int, length long, {name} string")
        placed = best_fit(pieces, 16)
        assert placed.columns == [c for c in pieces.columns if c not in ("sequence_id", "offset")] + ["sequence_id", "offset"]
        got = placed.collect()
        assert len(got) == 50 and all(r.sequence_id is not None for r in got)
        if name.startswith("_"):
            assert {r[3] for r in got} == {"clash"}


def test_long_words_take_bounded_memory():
    import tracemalloc

    table = CountTable(Unigram.from_vocabulary(PIECES), limit=1000)
    model = table.trie.model
    for word in ("", "a", "hello", "Donaudampfschiff" * 40, "漢字é" * 500, "x1" * 3000):
        assert model.count("▁" + word) == Trie(model).insert("▁" + word)
    long = ("thederingandtion" * 20_000).encode()
    tracemalloc.start()
    assert table.counts([long + b" a", b"a"])[0] == [2, 1]
    assert tracemalloc.get_traced_memory()[1] < 20_000_000 and long not in table
    tracemalloc.stop()
