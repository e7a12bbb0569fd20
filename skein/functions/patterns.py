"""Search patterns: Java regular expressions, POSIX basic ones and literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DIALECTS = ("java", "basic", "literal")

# The characters that make a pattern more than a literal, per dialect.
SPECIAL = {"java": r"[.\[\]*^$\\(){}|+?]", "basic": r"[.\[*^$\\]", "literal": r"(?!)"}

# POSIX class names and their Java spelling inside brackets.
POSIX_CLASSES = {
    "alpha": r"\p{Alpha}",
    "digit": r"\p{Digit}",
    "alnum": r"\p{Alnum}",
    "upper": r"\p{Upper}",
    "lower": r"\p{Lower}",
    "space": r"\s",
    "blank": r"\p{Blank}",
    "punct": r"\p{Punct}",
    "print": r"\p{Print}",
    "graph": r"\p{Graph}",
    "cntrl": r"\p{Cntrl}",
    "xdigit": r"\p{XDigit}",
}

_BASIC_TOKEN = re.compile(r"\\(?P<escaped>.)|(?P<bracket>\[\^?\]?(?:\[:\w+:\]|[^\]])*\])|(?P<plain>.)", re.S)


def is_literal(pattern: str, dialect: str) -> bool:
    return re.search(SPECIAL[dialect], pattern) is None


def is_literal_column(pattern: Column, dialect: str) -> Column:
    return F.lit(True) if dialect == "literal" else ~F.rlike(pattern, F.lit(SPECIAL[dialect]))


def bracket(body: str, negated: bool) -> str:
    """A Java character class for what stands between the brackets of a POSIX one."""
    names = re.split(r"\[:(\w+):\]", body)
    members = "".join(
        POSIX_CLASSES[part] if i % 2 else re.sub(r"([\\\[\]&^])", r"\\\1", part) for i, part in enumerate(names)
    )
    return f"[{'^' if negated else ''}{members}]"


def basic_to_java(pattern: str) -> str:
    """A POSIX basic regular expression in Java spelling.

    Bare ``( ) { } | + ?`` are literal and their escaped forms are operators; ``*`` is literal
    where nothing stands before it, ``^`` and ``$`` anchor only at the ends of an expression.
    """
    tokens = list(_BASIC_TOKEN.finditer(pattern))
    out: list[str] = []
    opening = True  # at the start of an expression: nothing to repeat, ^ anchors
    for i, token in enumerate(tokens):
        escaped, inside, plain = token.group("escaped", "bracket", "plain")
        following = tokens[i + 1].group(0) if i + 1 < len(tokens) else None
        starts_next = False
        if escaped is not None:
            if escaped in "(){}|+?":
                out.append("\\" + escaped if opening and escaped in "+?{" else escaped)
                if escaped == "{" and not opening and following == ",":
                    out.append("0")  # Java wants the lower bound in writing
                starts_next = escaped in "(|"
            elif escaped in "<>":
                out.append(r"\b(?=\w)" if escaped == "<" else r"\b(?<=\w)")
            elif escaped in "wWsSbB" or escaped in "123456789":
                out.append("\\" + escaped)
            else:
                out.append(re.escape(escaped))
        elif inside is not None:
            negated = inside.startswith("[^")
            out.append(bracket(inside[2 if negated else 1 : -1], negated))
        elif plain == "*" and opening:
            out.append(r"\*")
        elif plain == "^":
            out.append("^" if opening else r"\^")
            starts_next = opening
        elif plain == "$":
            out.append("$" if following in (None, r"\)", r"\|") else r"\$")
        elif plain in ".*":
            out.append(plain)
        else:
            out.append(re.escape(plain))
        opening = starts_next
    return "(?d)" + "".join(out)


def matches(text: Column, pattern: str, dialect: str) -> Column:
    """Boolean column: does ``text`` hold a match of ``pattern``? Plain literals skip the regex engine."""
    if dialect not in DIALECTS:
        raise ValueError(f"unknown pattern dialect {dialect!r}")
    if is_literal(pattern, dialect):
        return F.contains(text, F.lit(pattern))
    return F.rlike(text, F.lit(basic_to_java(pattern) if dialect == "basic" else pattern))


def may_match_file(text: Column, pattern: str, dialect: str) -> Column | None:
    """A whole-file condition that holds whenever one line matches, or None when there is no cheap one."""
    if is_literal(pattern, dialect) and "\n" not in pattern:
        return F.contains(text, F.lit(pattern))
    if dialect == "basic":
        return F.rlike(text, F.lit("(?m)" + basic_to_java(pattern)))
    return None
