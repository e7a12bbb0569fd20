"""Path handling as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.patterns import bracket


def segments(path: Column) -> Column:
    return F.split(path, "/", -1)


def base_name(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the base name, empty when there is none."""
    return F.regexp_extract(path, r"[^/.][^/]*\.([^/.]*)\z", 1)


def module_path(path: Column, strip_prefix: str | None = None) -> Column:
    """``src/app/models.py`` -> ``src.app.models``: the last extension goes, slashes become dots.

    ``strip_prefix`` removes a leading root first (off by default).
    """
    if strip_prefix:
        path = F.when(F.startswith(path, F.lit(strip_prefix)), F.substr(path, F.lit(len(strip_prefix) + 1))).otherwise(path)
    return F.translate(F.regexp_replace(path, r"([^/.][^/]*)\.[^/.]*\z", "$1"), "/", ".")


def contains_any(path: Column, parts: Sequence[str]) -> Column:
    """True when any of ``parts`` is a substring of the whole path."""
    return reduce(lambda a, b: a | b, [F.contains(path, F.lit(part)) for part in parts], F.lit(False))


_GLOB_TOKEN = re.compile(r"\\(?P<escaped>.)|(?P<many>\*)|(?P<one>\?)|\[(?P<negated>[!^]?)(?P<members>\]?(?:\[:\w+:\]|[^\]])*)\]", re.S)


def glob_regex(glob: str) -> str:
    """A shell glob as an anchored Java regex; a backslash makes the next character itself."""
    out, at = [], 0
    for found in _GLOB_TOKEN.finditer(glob):
        out.append(re.escape(glob[at : found.start()]))
        if found["many"]:
            out.append(".*")
        elif found["one"]:
            out.append(".")
        elif found["escaped"]:
            out.append(re.escape(found["escaped"]))
        else:
            out.append(bracket(found["members"], bool(found["negated"])))
        at = found.end()
    out.append(re.escape(glob[at:]))
    return r"(?s)\A" + "".join(out) + r"\z"


def base_name_matches(path: Column, globs: Sequence[str]) -> Column:
    """True when the base name matches at least one glob."""
    name = base_name(path)
    return reduce(lambda a, b: a | b, [F.rlike(name, F.lit(glob_regex(glob))) for glob in globs])


def directory_matches(path: Column, globs: Sequence[str]) -> Column:
    """True when a directory segment of the path matches at least one glob."""
    parts = segments(path)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    regexes = [glob_regex(glob) for glob in globs]
    return F.exists(folders, lambda part: reduce(lambda a, b: a | b, [F.rlike(part, F.lit(r)) for r in regexes]))
