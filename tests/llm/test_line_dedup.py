"""Repeated multi-line chunks against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from skein.llm.line_dedup import chunk_ends, chunks, without_repeated_chunks
from skein.llm.queries import QUERIES
from tests.llm.helpers import SF, empty_documents, odd_documents, plain


def expected(rows) -> list[tuple]:
    """``doc_id, text left, lines, removed lines``, deciding chunk by chunk in the order of ids."""
    first: dict[bytes, tuple] = {}
    for r in rows:
        text = (r.text or "").encode()
        for k, (a, b, multi) in enumerate(chunks(text)):
            chunk = b"\n".join(text.split(b"\n")[a:b])
            place = (r.doc_id is None, r.doc_id or 0, text, k)
            if multi and (chunk not in first or place < first[chunk]):
                first[chunk] = place
    out = []
    for r in rows:
        text = (r.text or "").encode()
        lines, left, gone = text.split(b"\n"), [], 0
        for k, (a, b, multi) in enumerate(chunks(text)):
            if multi and first[b"\n".join(lines[a:b])] != (r.doc_id is None, r.doc_id or 0, text, k):
                gone += b - a
            else:
                left += lines[a:b]
        out.append((r.doc_id, b"\n".join(left).decode() if gone else r.text, len(lines), gone))
    return sorted(out, key=repr)


def test_borders_do_not_move_with_what_stands_before():
    rng = random.Random(1)
    passage = [b"line %d" % rng.randrange(10**6) for _ in range(400)]
    cut = {passage[e - 1] for e in chunk_ends(passage)[:-1]}
    assert 50 < len(cut) < 200
    for before in (1, 2, 7):
        lines = [b"other %d" % i for i in range(before)] + passage
        moved = {lines[e - 1] for e in chunk_ends(lines)[:-1]}
        assert cut - {passage[0], passage[1]} <= moved


def test_chunks_cover_the_text():
    for text in (b"", b"a", b"a\nb", b"\n\n\n", b"a\n\nb\n", b"same\n" * 50):
        places = chunks(text)
        assert places[0][0] == 0 and places[-1][1] == len(text.split(b"\n"))
        assert all(a[1] == b[0] for a, b in zip(places, places[1:]))


def test_every_chunk_has_two_word_lines():
    rng = random.Random(3)
    for blanks in (0, 1, 2):
        for n in [*range(2, 12), 500]:
            lines = [part for _ in range(n) for part in (b"line %d" % rng.randrange(10**6), *[b""] * blanks)]
            places = chunks(b"\n".join(lines))
            assert all(sum(1 for line in lines[a:b] if line) >= 2 for a, b, _ in places)
            assert n < 500 or 100 < len(places) < 150


def test_planted_passages_go_whole(spark):
    """A copy of a text leaves nothing; of a passage inside others, only lines next to its two ends stay."""
    rng = random.Random(4)
    rows = []
    for k in range(60):
        passage = [f"passage {k} {rng.random()}" for _ in range(rng.randint(2, 40))]
        if k % 3:
            passage = [part for line in passage for part in (line, *[""] * (k % 3))]
        rows += [(3 * k, "\n".join(passage)), (3 * k + 1, "\n".join(passage))]
        rows.append((3 * k + 2, "\n".join([f"before {k} {i}" for i in range(9)] + passage + [f"after {k} {i}" for i in range(9)])))
    left = {r.doc_id: r for r in without_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    inside = 0
    for k in range(60):
        assert left[3 * k].n_removed == 0 and left[3 * k].text == rows[3 * k][1]
        assert left[3 * k + 1].text == "" and left[3 * k + 1].n_removed == left[3 * k + 1].n_lines
        lines, kept = rows[3 * k + 2][1].split("\n"), left[3 * k + 2].text.split("\n")
        head = next((i for i, (a, b) in enumerate(zip(lines, kept)) if a != b), len(kept))
        assert kept[head:] == lines[len(lines) - (len(kept) - head) :]  # one hole, no stub inside it
        assert [x for x in lines if x.startswith(("before", "after"))] == [x for x in kept if x.startswith(("before", "after"))]
        inside += left[3 * k + 2].n_removed
    assert inside > 400


def test_repeated_chunks_go(spark):
    rng = random.Random(2)
    passages = [[f"p{p} line {i}" for i in range(rng.randint(2, 14))] for p in range(8)] + [[""] * 6]
    rows = []
    for doc in range(80):
        lines: list[str] = []
        for _ in range(rng.randint(0, 3)):
            lines += rng.choice(passages) + [f"own {doc} {rng.random()}"] * rng.randint(0, 2)
        rows.append((rng.randrange(500), "\n".join(lines), 7))
    rows += rows[:4] + [(None, rows[5][1], 7), (900, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines long")
    got = without_repeated_chunks(docs)
    assert got.columns == ["doc_id", "text", "n_lines", "n_removed"]
    assert plain(got) == expected(docs.collect())
    assert got.agg(F.sum("n_removed")).first()[0] > 100


def test_odd_documents(spark):
    docs = odd_documents(spark)
    got = without_repeated_chunks(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"]
    assert plain(got.select("doc_id", "text", "n_lines", "n_removed")) == expected(docs.collect())
    assert without_repeated_chunks(empty_documents(spark)).count() == 0


def test_line_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [(i, n, gone, text or "") for i, text, n, gone in expected(docs.collect())]
    got = QUERIES["op4_line_dedup"](spark, SF)
    want = spark.createDataFrame(kept, "doc_id long, n_lines long, n_removed long, text string")
    assert plain(got) == plain(want.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256)))
