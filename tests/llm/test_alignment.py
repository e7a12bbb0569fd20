"""Token alignment against a plain walk over both tokenizations."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from skein.llm import token_alignment as alignment
from skein.llm.queries import QUERIES, tokenizer_file
from skein.llm.token_alignment import align, aligned_groups, alignment_counts
from tests.llm.helpers import SF, TEXTS, empty_documents, odd_documents, plain
from tests.llm.test_tokens import random_texts

BPE, PIECES = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE = {chr(b): b for b in PRINTABLE}
BYTE |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    s = SentencePieceProcessor(model_file=PIECES)

    def of(text: str | None) -> tuple[list, list]:
        """Ids with their bytes by both, none where the bytes are not those of a space and the text."""
        if not text:
            return [], []
        a = [(i, bytes(BYTE[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode()) for i in s.encode(text)]
        spelled = all(b"".join(x for _, x in ids) == (" " + text).encode() for ids in (a, b))
        return (a, b) if spelled else ([], [])

    return of


def spans(ids) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for i, name in ids:
        out.append((i, at, at + len(name)))
        at += len(name)
    return out


def plain_alignment(both, text) -> tuple[list, list]:
    """Groups as two lists of ids, and links as pairs of ids, by the definition."""
    a, b = map(spans, both(text))
    common = sorted({end for _, _, end in a} & {end for _, _, end in b})
    groups = [([i for i, s, e in a if first <= s < last], [i for i, s, e in b if first <= s < last]) for first, last in zip([0, *common], common)]
    links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
    return groups, links


def plain_counts(both, rows) -> list[tuple]:
    found = [(r[0], *plain_alignment(both, r[1]), *both(r[1])) for r in rows]
    count = Counter(link for _, _, links, _, _ in found for link in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for i, groups, links, a, b in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        n_best = sum(count[link] == best[link[1]] for link in links)
        sha = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((i, len(a), len(b), len(groups), len(links), n_best, sum(count[link] for link in links), sha))
    return sorted(out, key=repr)


SHORT = [t if t is None or len(t) < 5000 else t[:3000] for t in TEXTS]


def short_documents(spark):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 5000 else r.text[-3000:], r.source, r.hash) for r in odd_documents(spark).collect()]
    rows += [(2000 + i, t, "block", "links") for i, t in enumerate(random_texts(60, 9) + ["a▁b", "<|endoftext|> x", "<s> </s>", "x" * 300, " ", "  a"])]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, links string")


@pytest.mark.parametrize("single_ends", [1, 3, 32])
def test_align(monkeypatch, single_ends):
    monkeypatch.setattr(alignment, "SINGLE_ENDS", single_ends)
    rng = random.Random(single_ends)
    for _ in range(400):
        size = rng.randint(1, 200)
        same = set(rng.sample(range(1, size + 1), rng.randint(0, size)))
        a, b = (np.array(sorted(same | set(rng.sample(range(1, size + 1), rng.randint(0, min(5, size)))) | {size})) for _ in "ab")
        inner_a, around_a, inner_b, around_b = (x.tolist() for x in align(a, b))
        assert inner_a == [i for i, e in enumerate(a) if e not in set(b.tolist())]
        assert inner_b == [i for i, e in enumerate(b) if e not in set(a.tolist())]
        assert around_a == np.searchsorted(b, a[inner_a]).tolist() and around_b == np.searchsorted(a, b[inner_b]).tolist()
    assert all(len(x) == 0 for x in align(np.zeros(0, np.int64), np.zeros(0, np.int64)))


@pytest.mark.parametrize(("block", "together"), [(1 << 23, 1 << 19), (400, 50)])
def test_counts(spark, both, monkeypatch, block, together):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    monkeypatch.setattr(alignment, "ALIGNED_BYTES", together)
    docs = short_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    documents, links = alignment_counts(docs, BPE, PIECES)
    assert plain(documents) == plain_counts(both, rows)
    count = Counter(link for _, t in rows for link in plain_alignment(both, t)[1])
    assert {(r.a_id, r.b_id): r.n for r in links.collect()} == count


def test_groups(spark, both):
    docs = short_documents(spark)
    for r in aligned_groups(docs, BPE, PIECES).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect():
        if r.doc_id in (2060, 2061, 2062, 2063):
            groups, _ = plain_alignment(both, r.text)
            cuts = zip([0, *r.groups_a], r.groups_a, [0, *r.groups_b], r.groups_b)
            assert [(list(r.a[p:q]), list(r.b[s:t])) for p, q, s, t in cuts] == groups
    assert aligned_groups(docs, BPE, PIECES).count() == docs.count()


def test_no_documents(spark):
    documents, links = alignment_counts(empty_documents(spark), BPE, PIECES)
    assert documents.count() == 0 and links.count() == 0
    documents, links = alignment_counts(odd_documents(spark).filter("text is null or text = ''"), BPE, PIECES)
    assert {r[1:] for r in documents.collect()} == {(0, 0, 0, 0, 0, 0, "")} and links.count() == 0


def test_query(spark, both):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in QUERIES["op13_token_alignment"](spark, SF).collect()}
    assert got.keys() == {i for i, _ in rows}
    for i, text in rows:
        a, b = both(text)
        assert (got[i].n_a, got[i].n_b) == (len(a), len(b))
    few = [(i, t) for i, t in rows if t and len(t) < 1500][:40]
    want = {r[0]: r for r in plain_counts(both, few)}
    for i, _ in few:
        assert (got[i].n_groups, got[i].n_links, got[i].groups_sha256) == (want[i][3], want[i][4], want[i][7])
