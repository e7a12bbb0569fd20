"""Documents with odd texts, and rows as plain values."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
TEXTS = [
    None, "", " ", "  \t\n", "one", "Same Text here", "same text HERE", "same text here", "École ÀÉ", "école ÀÉ",
    "a  b   c ", " lead", "tail \n", "line one\nline one\nline two", "x\x1cy\x85z w v", "▁marked ▁▁ word", "ﬁ ½ \U0001f600 漢字 \u0000nul",
    "don't you're  12 345\n\n  x", "<|endoftext|> <s> </s> <0x41>", "#" * 50, LONG, LONG, LONG + " end",
    "alpha beta gamma delta epsilon zeta eta theta " * 12, " ".join("abcdefghijklmnopqrstuvwxyz"),
]


def odd_documents(spark, extra: str = "source"):
    """The odd texts with ids in another order, a repeated row, a null id, and columns that clash with the operators' own."""
    rows = [((i * 7) % 1000, t, None if i % 5 == 0 else f"src{i % 2}", "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, "no id at all", None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra} string, hash string")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, n_chars long")


def plain(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")
