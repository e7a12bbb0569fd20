"""Substring search over distinct names through posting lists of short grams.

A posting says that a (name, kind) holds a gram: one to three neighbouring characters of the lower-cased name. It carries the first qualified name of that pair, so the
matches of a request can be cut to its limit before any symbol is looked up. A request reads the posting list of its rarest gram and verifies what is there.

Postings can be published with an index; without them they are made from the symbols, for the grams that the requests ask for. Made ones hold longer grams
too, of 6, 12, 24 and 48 characters, for the first and the last of which a long request asks: numbered names share all their short grams with many others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.answers import ranked
from skein.functions.membership import bits_for, may_be_in, membership
from skein.session import cut, fits_broadcast
from skein.sources.store import Change

GRAM = 3
# Lengths of grams that are made for long requests; of published ones the longest is GRAM.
LONG_GRAMS = (6, 12, 24, 48)


def grams(text: Column, length: int) -> Column:
    """Distinct substrings of ``text`` with ``length`` characters."""
    count = F.char_length(text) - (length - 1)
    places = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda at: F.substring(text, at, F.lit(length))))


def _all_grams(text: Column) -> Column:
    return F.concat(*[grams(text, n) for n in range(1, GRAM + 1)])


def named(symbols: DataFrame) -> DataFrame:
    """``name, kind, first_qualified``: every pair of name and kind with its first qualified name."""
    return symbols.groupBy("name", "kind").agg(F.min("qualified_name").alias("first_qualified"))


def name_grams(symbols: DataFrame) -> DataFrame:
    """The posting lists ``gram, name, kind, first_qualified`` of all names."""
    pairs = named(symbols.filter(F.isnotnull("name")))
    return pairs.select(F.explode(_all_grams(F.lower("name"))).alias("gram"), "name", "kind", "first_qualified")


def change_of_grams(old_symbols: DataFrame, new_symbols: DataFrame, symbols: DataFrame) -> Change:
    """Postings after an update: those of names that a changed file had or has are made anew from ``symbols``, the updated table."""
    names = cut(old_symbols.select("name").union(new_symbols.select("name")).filter(F.isnotnull("name")).distinct(), "posted-names")
    fresh = cut(name_grams(symbols.join(names, "name", "left_semi")), "new-postings")
    keys = cut(names.select(F.explode(_all_grams(F.lower("name"))).alias("key")).distinct(), "posted-grams")
    return Change(keys, lambda old: old.join(names, "name", "left_anti").select("gram", "name", "kind", "first_qualified").unionByName(fresh))


def _like(text: Column, pattern: Column) -> Column:
    """SQL LIKE with a free end on both sides; a control character escapes, so a backslash is itself."""
    body = F.replace(pattern, F.lit("\x01"), F.lit("\x01\x01"))
    return F.like(text, F.concat(F.lit("%"), body, F.lit("%")), F.lit("\x01"))


def _long_grams(runs: Column, longest: Column) -> Column:
    """The first and the last gram of the longest run, as long as a made gram can be; null if the run is too short for one."""
    run = F.element_at(F.filter(runs, lambda r: F.char_length(r) == longest), 1)

    def ends(n: int) -> Column:
        return F.array(F.substring(run, F.lit(1), F.lit(n)), F.substring(run, longest - (n - 1), F.lit(n)))

    return F.coalesce(*[F.when(longest >= n, ends(n)) for n in sorted(LONG_GRAMS, reverse=True)])


def _gram_of(runs: Column, long: bool) -> Column:
    """What to look up for a request: the grams of its runs without wildcards, of three characters if a run is so long, else of the longest run.

    With ``long`` a run of six characters or more is looked up by two longer grams.
    """
    longest = F.array_max(F.transform(runs, F.char_length))
    of_length = [_long_grams(runs, longest)] if long else []
    of_length += [F.when(longest >= GRAM if n == GRAM else longest == n, F.flatten(F.transform(runs, lambda run: grams(run, n)))) for n in range(GRAM, 0, -1)]  # noqa: B023
    return F.array_distinct(F.coalesce(*of_length, F.array().cast("array<string>")))


def _fits_kind(kind: str = "kind") -> Column:
    return F.isnull("req_kind") | (F.col(kind) == F.col("req_kind"))


def matching_names(
    symbols: DataFrame, wanted: DataFrame, limit: int | None, wildcards: bool, postings: DataFrame | None = None
) -> DataFrame:
    """``asked, req_kind, name, kind`` for distinct ``wanted(asked, req_kind)``: pairs of name and kind whose name holds the text asked for, whatever the case.

    With a limit only the pairs with the smallest first qualified names are given, as many as the limit: the first symbols of an answer are all among theirs.
    """
    lowered = F.lower("asked")
    runs = F.split(lowered, "[%_]", -1) if wildcards else F.array(lowered)
    wanted = wanted.withColumns({"grams": _gram_of(runs, postings is None), "wild": F.rlike("asked", F.lit("[%_]")) if wildcards else F.lit(False)})
    wanted = cut(wanted, "substring-requests")
    by_gram = _by_rarest(symbols, wanted, postings)

    # a request of wildcards only, or of nothing, asks for names with as many characters as it has underscores
    short = wanted.filter(F.size("grams") == 0).select("asked", "req_kind", F.length(F.regexp_replace("asked", "[^_]", "")).alias("least"))
    parts = [by_gram]
    if not short.isEmpty():
        needs = cut(short.select("least", "req_kind").distinct(), "short-requests")
        near = F.broadcast(needs) if fits_broadcast(needs) else needs
        met = named(symbols.filter(F.isnotnull("name"))).join(near, (F.char_length("name") >= F.col("least")) & _fits_kind())
        met = ranked(met, ["least", "req_kind"], ["first_qualified", "name", "kind"], limit).drop("rank")
        same = short["least"].eqNullSafe(met["least"]) & short["req_kind"].eqNullSafe(met["req_kind"])
        parts.append(short.join(met, same).select("asked", short["req_kind"], "name", "kind", "first_qualified"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return ranked(found, ["asked", "req_kind"], ["first_qualified", "name", "kind"], limit).select("asked", "req_kind", "name", "kind")


def _made_grams(symbols: DataFrame, looked_up: DataFrame) -> DataFrame:
    """The posting lists of ``looked_up(gram)``, and a few others: only grams of the lengths asked for are made, and a bitmap stops most that nobody asks for."""
    asked = looked_up.groupBy(F.char_length("gram").alias("length")).agg(F.count(F.lit(1)).alias("n")).collect()
    lengths = sorted(row["length"] for row in asked)
    if not lengths:
        return name_grams(symbols).limit(0)
    bits = bits_for(sum(row["n"] for row in asked))
    pairs = named(symbols.filter(F.isnotnull("name")))
    made = F.concat(*[grams(F.lower("name"), n) for n in lengths])
    lists = pairs.select(F.explode(made).alias("gram"), "name", "kind", "first_qualified")
    return may_be_in(lists, "gram", membership(looked_up, "gram", bits), bits)


def _by_rarest(symbols: DataFrame, wanted: DataFrame, postings: DataFrame | None) -> DataFrame:
    asked = wanted.select("asked", F.explode("grams").alias("gram")).distinct()
    looked_up = cut(asked.select("gram").distinct(), "asked-grams")
    near = F.broadcast(looked_up) if fits_broadcast(looked_up) else looked_up
    if postings is None:
        lists = cut(_made_grams(symbols, looked_up).join(near, "gram", "left_semi"), "postings")
    else:
        lists = postings.join(near, "gram", "left_semi")
    sizes = lists.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a gram that is in no name has no list: it is the rarest of all, and its request has no match
    rarest = asked.join(sizes, "gram", "left").groupBy("asked")
    rarest = rarest.agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    rarest = cut(wanted.select("asked", "req_kind", "wild").join(rarest, "asked"), "rarest-grams")
    fits = F.when(F.col("wild"), _like(F.lower("name"), F.lower("asked"))).otherwise(F.contains(F.lower("name"), F.lower("asked")))
    met = lists.join(F.broadcast(rarest) if fits_broadcast(rarest) else rarest, "gram")
    return met.filter(fits & _fits_kind()).select("asked", "req_kind", "name", "kind", "first_qualified")
