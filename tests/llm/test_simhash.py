"""SimHash fingerprints, the covering code and the components against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash

from skein.llm.components import components
from skein.llm.queries import QUERIES
from skein.llm.simhash import anchors, fingerprint, links, local_links, near_duplicates, syndrome
from tests.llm.helpers import SF, TEXTS, empty_documents, odd_documents, plain, words

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_fingerprint(text, k: int = 3) -> int:
    own = words((text or "").translate(UPPER))
    if not own:
        return 0
    grams = [" ".join(own[i : i + k]) for i in range(max(1, len(own) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [t for t in TEXTS if not t or len(t) < 5000] + ["a b", "a b c", "a b c d", "A b\tC\n\nd"]:
        for k in (3, 5):
            assert fingerprint((text or "").encode(), k) % 2**64 == plain_fingerprint(text, k)


def test_anchors_cover():
    rng = np.random.default_rng(0)
    halves = np.concatenate([rng.integers(0, 1 << 32, 300), [0, (1 << 32) - 1, 1 << 31]])
    rows, found, home = anchors(halves)
    assert not syndrome(found).any() and (np.bitwise_count(halves[rows] ^ found) <= 2).all()
    met = {(int(r), int(a)) for r, a in zip(rows, found)}
    assert len(met) == len(rows) and np.bincount(rows).max() == 17
    assert (np.bincount(rows[home]) == 1).all() and (np.bitwise_count(halves[rows[home]] ^ found[home]) <= 1).all()
    for bit in [None, *range(32)]:  # whatever one bit differs in, both meet at either home
        others = halves ^ (0 if bit is None else 1 << bit)
        rows2, found2, _ = anchors(others)
        met2 = {(int(r), int(a)) for r, a in zip(rows2, found2)}
        assert all((int(r), int(a)) in met2 for r, a in zip(rows[home], found[home]))


def plain_components(prints: list[int]) -> dict[int, int]:
    label = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for p in prints:
            for q in prints:
                if (p ^ q).bit_count() <= 3 and label[q] < label[p]:
                    label[p] = label[q]
                    changed = True
    return label


def signed(p: int) -> int:
    return p - 2**64 if p >= 2**63 else p


def clustered(seed: int, n: int = 220) -> list[int]:
    rng = random.Random(seed)
    found = {0}
    for _ in range(4):
        p = rng.getrandbits(64)
        for _ in range(n // 4):
            for _ in range(rng.randint(0, 3)):
                p ^= 1 << rng.randrange(64)
            found.add(p)
    return sorted(found)


def test_links_and_components(spark):
    for seed, block in ((1, 4096), (2, 3)):  # small blocks: every anchor is dealt out
        prints = clustered(seed)
        df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
        got = {r.node % 2**64: r.label for r in components(links(df, block)).collect()}
        want = plain_components(prints)
        groups: dict[int, set] = {}
        for p in prints:
            groups.setdefault(want[p], set()).add(p)
        for group in groups.values():
            assert len({got.get(p, signed(p)) for p in group}) == 1
        assert len({got.get(p, signed(p)) for p in prints}) == len(groups)


def test_local_links_are_a_forest():
    prints = np.array([signed(p) for p in clustered(5)], np.int64)
    roots, members = local_links(prints, np.ones(len(prints), bool))
    assert len(set(members.tolist())) == len(members) < len(prints)


def test_long_chain(spark):
    chain = spark.range(300).selectExpr("id * 7 % 301 AS a", "(id + 1) * 7 % 301 AS b")
    assert {r.label for r in components(chain).collect()} == {0}
    assert components(chain.limit(0)).count() == 0


def expected(rows, k: int = 3) -> list[tuple]:
    own = [(r.doc_id, plain_fingerprint(r.text, k)) for r in rows]
    label = plain_components(sorted({p for _, p in own}))
    smallest: dict[int, int] = {}
    for doc, p in own:
        if doc is not None:
            smallest[label[p]] = min(doc, smallest.get(label[p], doc))
    return sorted(((doc, f"{p:016x}", smallest.get(label[p])) for doc, p in own), key=repr)


def test_near_duplicates(spark):
    docs = odd_documents(spark)
    assert plain(near_duplicates(docs).drop("text_key")) == expected(docs.collect())
    assert near_duplicates(empty_documents(spark)).count() == 0


def test_simhash_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert plain(QUERIES["op6_simhash"](spark, SF).drop("text_key")) == expected(docs)
