"""Quality rules per document, and a verdict per host from the share of its documents that fail them.

Only DataFrame functions are used. A document is one row from the scan to the counts: its words, windows and lines stay
in arrays of that row, so the counts shuffle nothing. Hosts are aggregated with map-side sums, and their verdicts go
back by a join on the host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import text_key
from skein.session import cut

_SPACE = " \t\n\x0b\x0c\r"
_SPACE_RUN = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Rules:
    """Limits of the document rules, and the share of failing documents at which a host is rejected."""

    least_words: int = 20
    most_repeated_percent: int = 30
    most_symbol_percent: int = 30  # symbols per 100 characters of words
    most_dup_line_percent: int = 50  # repeated lines per 100 lines with a word
    host_limit: float = 0.8


def _sorted_windows(words: Column) -> Column:
    """Windows of eight words as ``(w, i)``, sorted by their text ``w`` and then by their place ``i``."""
    places = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.array_sort(F.transform(places, lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("i"))))


def _repeated_places(windows: Column) -> Column:
    """Places, in order, of the sorted ``windows`` that have an equal neighbour."""

    def equal(i: Column, j: Column) -> Column:
        return F.get(windows, i)["w"] == F.get(windows, j)["w"]

    before = lambda i: F.when(i > 0, equal(i, i - 1)).otherwise(False)
    after = lambda i: F.when(i < F.size(windows) - 1, equal(i, i + 1)).otherwise(False)
    repeated = F.filter(windows, lambda x, i: before(i) | after(i))
    return F.array_sort(F.transform(repeated, lambda x: x["i"]))


def _covered_words(places: Column) -> Column:
    """Number of words in windows that begin at ``places``: each adds eight, or what is left up to the next one."""
    gaps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``doc_id, host`` and the counts that the rules look at, one row per row of ``docs``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text.alias("text"))
    bare = F.btrim("text", F.lit(_SPACE))
    rows = rows.select(
        "doc_id",
        "host",
        text_key().alias("text_key"),
        F.char_length(F.translate("text", _SPACE, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(_NOT_SPACE)).alias("lines"),
        F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SPACE_RUN)).alias("words"),
    )
    words = F.col("words")
    window_hash = F.transform(F.sequence(F.lit(1), F.size(words) - WINDOW + 1), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    rows = rows.select(
        "doc_id",
        "host",
        "text_key",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "words",
        F.when(F.size("words") > WINDOW, window_hash).alias("windows"),
    )
    # equal hashes only choose the documents to look at; the windows themselves are compared
    suspect = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("keyed", F.when(suspect, _sorted_windows(words))).drop("words", "windows")
    rows = rows.withColumn("places", F.when(F.isnotnull("keyed"), _repeated_places(F.col("keyed")))).drop("keyed")
    repeated = F.when(F.isnotnull("places"), _covered_words(F.col("places"))).otherwise(0)
    return rows.withColumn("n_repeat_words", repeated.cast("long")).drop("places")


def host_verdicts(counts: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``host, n_docs, worst_rate, rejected``: the largest of the shrunk failure rates of a host over the rules.

    For every rule the rates of the hosts give a beta prior by the method of moments: its mean is the rate over all
    documents, its weight follows from how much the rates of hosts differ beyond what their sizes explain. The rate of a host is the
    posterior mean, so a host with few documents stays near the mean. Documents without a host are one host.
    """
    names = ["short", "repeats", "symbols", "dup_lines"]
    flags = {
        "short": F.col("n_words") < rules.least_words,
        "repeats": 100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words"),
        "symbols": 100 * F.col("n_symbols") > rules.most_symbol_percent * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > rules.most_dup_line_percent * F.col("n_lines"),
    }
    hosts = counts.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(flags[n]).alias(n) for n in names])
    hosts = cut(hosts, "hosts")
    totals = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n_docs").alias("docs"), *[F.sum(n).alias(n) for n in names]).first()
    if not totals["docs"]:
        return hosts.select("host", "n_docs", F.lit(0.0).alias("worst_rate"), F.lit(False).alias("rejected"))
    means = {n: totals[n] / totals["docs"] for n in names}
    spread = hosts.agg(*[F.sum(F.col("n_docs") * (F.col(n) / F.col("n_docs") - means[n]) ** 2).alias(n) for n in names]).first()
    rates = []
    for n in names:
        weight = prior_weight(means[n], spread[n] / totals["docs"], totals["hosts"], totals["docs"])
        rates.append((F.col(n) + F.lit(means[n] * weight)) / (F.col("n_docs") + F.lit(weight)))
    hosts = hosts.select("host", "n_docs", F.greatest(*rates).alias("worst_rate"))
    return hosts.withColumn("rejected", F.col("worst_rate") > rules.host_limit)


def prior_weight(mean: float, variance: float, hosts: int, docs: int) -> float:
    """Documents that the beta prior counts for, from the weighted variance of the hosts' rates; 1 to 1,000,000."""
    sampling = mean * (1 - mean) * hosts / docs
    between = max(variance - sampling, 1e-12)
    return min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules = Rules()
) -> DataFrame:
    """The counts of every row of ``docs``, ``base_failed`` and ``kept``.

    A document fails when it has fewer than ``least_words`` words or more than ``most_repeated_percent`` of its words lie in
    repeated windows of eight; it is kept when it passes and its host is not rejected. Null and empty texts have no words and
    fail. Rows with one id are judged each by itself. An empty table gives no rows; other columns are ignored.
    """
    counts = cut(rule_counts(docs, id_col, text_col, host_col), "rules")
    verdicts = cut(host_verdicts(counts, rules), "verdicts").select(F.col("host").alias("of"), "rejected")
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeated_percent * F.col("n_words")
    )
    joined = counts.join(verdicts, F.col("host").eqNullSafe(F.col("of")), "left")
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~F.coalesce("rejected", F.lit(False))).alias("kept"), "text_key",
    )
