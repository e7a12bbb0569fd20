"""The pipeline, stage by stage, against the brute-force versions of the operators."""

from __future__ import annotations

import zlib
from collections import namedtuple

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from skein.llm.queries import tokenizer_file
from tests.llm import test_filters, test_line_dedup, test_simhash
from tests.llm.helpers import SF, empty_documents, words
from tests.llm.test_tokens import check_places, decreasing_best_fit

Doc = namedtuple("Doc", "doc_id text lang source n_chars")


def kept_words(rows, window: int = 50) -> list[str | None]:
    """Text of each row after the removal of windows that a smaller id has; null where nothing goes."""
    first: dict[tuple, int] = {}
    for r in rows:
        own = words(r.text)
        for i in range(len(own) - window + 1):
            w = tuple(own[i : i + window])
            first[w] = min(r.doc_id, first.get(w, r.doc_id))
    out = []
    for r in rows:
        own = words(r.text)
        gone = {j for i in range(len(own) - window + 1) if first[tuple(own[i : i + window])] < r.doc_id for j in range(i, i + window)}
        out.append(" ".join(w for i, w in enumerate(own) if i not in gone) if gone else None)
    return out


def by_id(rows) -> list[Doc]:
    return sorted((Doc(*r) for r in rows), key=lambda r: r.doc_id)


def retexted(docs: list[Doc], texts) -> list[Doc]:
    return [d._replace(text=t, n_chars=len(t or "")) for d, t in zip(docs, texts, strict=True)]


def expected(docs: list[Doc]) -> list[list[Doc]]:
    """Documents after each stage but the last."""
    kept = {r[0] for r in test_filters.verdicts(docs) if r[-1]}
    quality = [d for d in docs if d.doc_id in kept]
    texts = {i: t for i, t, _, _ in test_line_dedup.expected(quality)}
    lines = retexted(quality, [texts[d.doc_id] for d in quality])
    group = {i: c for i, _, c in test_simhash.expected(lines, corpus_pipeline.SHINGLE_WORDS)}
    near = [d for d in lines if group[d.doc_id] == d.doc_id]
    passages = [d if t is None else retexted([d], [t])[0] for d, t in zip(near, kept_words(near))]
    return [quality, lines, near, passages]


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected(by_id(docs.collect()))
    assert len({len(w) for w in want}) > 1 and want[0] != want[1] and want[2] != want[3]
    at = docs
    for (_, stage), after in zip(corpus_pipeline.STAGES, want):
        at = stage(spark, at, SF)
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        at = spark.createDataFrame(at.collect(), docs.schema)
        assert by_id(at.collect()) == after
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 0] for d in want[-1]}
    placed = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert {r.doc_id for r in placed} == ids.keys()
    assert sum(r.length for r in placed) == sum(map(len, ids.values()))
    for r in placed:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert check_places(placed, 2048) == decreasing_best_fit([r.length for r in placed], 2048)


def test_odd_rows_pass_through(spark):
    rows = [(1, None, None, None, None), (None, "word " * 30 + "x", "en", "s", 1), (2, "", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(90)), "en", None, 5)]
    rows += [rows[3], (3, "other " + rows[3][1], "en", "s", 1), (4, rows[3][1], "en", "s", 1)]
    at = spark.createDataFrame(rows, empty_documents(spark).select("doc_id", "text", "lang", "source", "n_chars").schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, SF).collect(), at.schema)
    left = sorted((r.doc_id or 0, r.text) for r in at.collect())
    assert (3, rows[3][1]) in left and all(i != 1 and i != 2 for i, _ in left)
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() == at.count()


def test_clashing_columns_and_no_sizes(spark):
    """Columns named like those the stages work with, and a table without ``n_chars``."""
    names = ["_gone_id", "_gone_key", "_removed", "_doc_id", "_text_key", "_id", "_key", "_kept", "kept_text", "removed", "text_key", "component_id", "fingerprint", "kept", "starts"]
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [f"one {passage} two", f"three {passage} four", "line of words\n" * 30, "five " * 25, None, " ".join(f"q{i}" for i in range(60))]
    rows = [(i, t, "en", "s", *["clash"] * len(names)) for i, t in enumerate(texts)]
    columns = ", ".join(["doc_id long, text string, lang string, source string", *[f"{n} string" for n in names]])
    at = bare = spark.createDataFrame(rows, columns)
    plain = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at, plain = stage(spark, at, SF), stage(spark, plain, SF)
        assert at.dtypes == bare.dtypes and plain.columns == ["doc_id", "text", "lang", "source"]
        at, plain = (spark.createDataFrame(x.collect(), x.schema) for x in (at, plain))
        assert sorted((r.doc_id, r.text) for r in at.collect()) == sorted((r.doc_id, r.text) for r in plain.collect())
        assert all(set(r[4:]) == {"clash"} for r in at.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() == at.count()


def test_no_documents(spark):
    at = empty_documents(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, SF)
        assert at.count() == 0
