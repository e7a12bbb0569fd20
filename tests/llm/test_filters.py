"""Exact duplicates and quality rules against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from skein.llm.exact_dedup import exact_duplicates
from skein.llm.queries import QUERIES
from skein.llm.quality_rules import Rules, prior_weight, quality_rules
from tests.llm.helpers import SF, TEXTS, empty_documents, odd_documents, plain, words

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def duplicates(rows, keep=max) -> list[tuple]:
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault((r.text or "").translate(UPPER), []).append(r.doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = keep(known) if known else None
        out += [(i, best, len(ids), i == best, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


def test_exact_duplicates(spark):
    docs = odd_documents(spark)
    assert plain(exact_duplicates(docs, keep="max")) == duplicates(docs.collect())
    assert plain(exact_duplicates(docs)) == duplicates(docs.collect(), min)
    assert exact_duplicates(empty_documents(spark)).count() == 0


def test_texts_that_share_a_hash_are_told_apart(spark):
    docs = odd_documents(spark)
    weak = exact_duplicates(docs, keep="max", content_hash=lambda text: F.char_length(text) % 3)
    assert plain(weak) == duplicates(docs.collect())


def test_exact_dedup_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert plain(QUERIES["op2_exact_dedup"](spark, SF)) == duplicates(docs)


def counts(text: str | None) -> tuple:
    text, own = text or "", words(text)
    lines = [line for line in text.split("\n") if words(line)]
    windows = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered), failed


def verdicts(rows, rules=Rules()) -> list[tuple]:
    """Counts, and the verdict of every host worked out anew."""
    by_host: dict = {}
    for r in rows:
        lines = len([x for x in (r.text or "").split("\n") if words(x)])
        n, chars, symbols, dups, repeats, _ = counts(r.text)
        flags = (n < rules.least_words, 100 * repeats > rules.most_repeated_percent * n, 100 * symbols > rules.most_symbol_percent * chars, 100 * dups > rules.most_dup_line_percent * lines)
        by_host.setdefault(r.source, []).append(flags)
    docs = sum(map(len, by_host.values()))
    rejected = set()
    for k in range(4):
        fails = {h: sum(f[k] for f in flags) for h, flags in by_host.items()}
        mean = sum(fails.values()) / docs
        variance = sum(len(by_host[h]) * (fails[h] / len(by_host[h]) - mean) ** 2 for h in by_host) / docs
        weight = prior_weight(mean, variance, len(by_host), docs)
        rejected |= {h for h in by_host if (fails[h] + mean * weight) / (len(by_host[h]) + weight) > rules.host_limit}
    return sorted(((r.doc_id, *counts(r.text), not counts(r.text)[5] and r.source not in rejected) for r in rows), key=repr)


def test_quality_rules(spark):
    docs = odd_documents(spark)
    assert plain(quality_rules(docs).drop("text_key")) == verdicts(docs.collect())
    assert quality_rules(empty_documents(spark)).count() == 0


def test_a_bad_host_is_rejected_and_a_small_one_is_not(spark):
    good, bad = " ".join(f"word{i}" for i in range(40)), "too short"
    rows = [(i, good, "fine") for i in range(200)] + [(1000 + i, bad, "spam") for i in range(99)] + [(2000, good, "spam")]
    rows += [(3000, bad, "tiny"), (3001, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert not got[2000] and got[0] and not got[3000] and got[3001]
    assert plain(quality_rules(docs).drop("text_key")) == verdicts(docs.collect())


def test_repeated_windows(spark):
    eight = "a b c d e f g h"
    texts = [eight, f"{eight} {eight}", f"{eight} x {eight} {eight} y", "a " * 9, "a " * 8, f"{eight} {eight[:-1]}i", *TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s"))
    assert [tuple(r)[:6] for r in quality_rules(docs).orderBy("doc_id").collect()] == [(i, *counts(t)[:5]) for i, t in enumerate(texts)]


def test_quality_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert plain(QUERIES["op10_quality_rules"](spark, SF)) == verdicts(docs)
