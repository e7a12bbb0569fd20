"""Window removal against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np

from skein.llm.hashing import rolling
from skein.llm.queries import QUERIES
from skein.llm.substring_dedup import repeated_names, substring_duplicates, window_names
from tests.llm.helpers import SF, empty_documents, odd_documents, plain, words


def expected(rows, window: int) -> list[tuple]:
    """``doc_id, n_words, n_removed, sha256 of the words left``."""
    first: dict[tuple, int] = {}
    for r in rows:
        own = words(r.text)
        if r.doc_id is not None:
            for i in range(len(own) - window + 1):
                w = tuple(own[i : i + window])
                first[w] = min(r.doc_id, first.get(w, r.doc_id))
    out = []
    for r in rows:
        own = words(r.text)
        gone = set()
        if r.doc_id is not None:
            for i in range(len(own) - window + 1):
                if first[tuple(own[i : i + window])] < r.doc_id:
                    gone.update(range(i, i + window))
        left = " ".join(w for i, w in enumerate(own) if i not in gone)
        out.append((r.doc_id, len(own), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df) -> list[tuple]:
    out = []
    for r in df.collect():
        sha = r.words_sha256.hex() if r.kept_text is None else hashlib.sha256(r.kept_text.encode()).hexdigest()
        out.append((r.doc_id, r.n_words, r.n_removed, sha))
    return sorted(out, key=repr)


def pasted(spark, seed: int):
    """Documents made of shared passages of many lengths between words of their own."""
    rng = random.Random(seed)
    passages = [[f"p{p}w{i}" for i in range(rng.randint(3, 40))] for p in range(12)] + [["same"] * 30]
    rows = []
    for doc in range(60):
        text: list[str] = []
        for _ in range(rng.randint(0, 5)):
            part = rng.choice(passages)
            a = rng.randrange(len(part))
            text += part[a : a + rng.randint(1, 40)] if rng.random() < 0.5 else part
            text += [f"d{doc}x{rng.random()}" for _ in range(rng.randint(0, 4))]
        rows.append((rng.randrange(1000), rng.choice([" ", "\n", "  "]).join(text), "x"))
    rows += [(5000 + i, rows[i][1], "x") for i in range(10)] + rows[:3] + [(rows[3][0], rows[4][1], "x"), (None, rows[5][1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, names string")


def test_windows_that_repeat_are_removed(spark):
    for seed, window, gram in ((1, 8, 3), (2, 8, 8), (3, 1, 1)):
        docs = pasted(spark, seed)
        got = substring_duplicates(docs, window=window, gram=gram, names_per_sketch=50)
        assert result(got) == expected(docs.collect(), window)


def test_odd_documents(spark):
    docs = odd_documents(spark)
    assert result(substring_duplicates(docs)) == expected(docs.collect(), 50)
    assert substring_duplicates(empty_documents(spark)).count() == 0


def test_rolling_and_names():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    h[200:260] = h[20:80]
    runs = rolling(h, 7)
    assert len(runs) == 294 and (runs[200:254] == runs[20:74]).all() and len(set(runs.tolist())) == 294 - 54
    names = window_names(h, 50, 10)
    assert len(names) == 251 and (names[200:211] == names[20:31]).all()


def test_sketch_loses_nothing(spark):
    rng = random.Random(4)
    names = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    df = spark.createDataFrame([(n,) for n in names + names[:400]], "name long").repartition(5)
    got = {r.name for r in repeated_names(df, 1000).collect()}
    assert set(names[:400]) <= got and len(got) < 600


def test_substring_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert plain(QUERIES["op9_substring_dedup"](spark, SF)) == expected(docs, 50)
