"""From source text to symbols and raw edges in one narrow stage."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.paths import module_path
from skein.schemas import EDGES, SYMBOL
from skein.sources.files import dispatch

EXTRACTED = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("module", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("symbols", T.ArrayType(SYMBOL)),
        T.StructField("raw_edges", T.ArrayType(EDGES)),
    ]
)

_ARROW_SYMBOL = pa.struct(
    [
        (name, pa.int32() if name in ("line_start", "line_end", "ordinal") else pa.string())
        if name != "extra"
        else (name, pa.map_(pa.string(), pa.string()))
        for name in SYMBOL.names
    ]
)
_ARROW_EDGE = pa.struct([(name, pa.string()) for name in EDGES.names])
_ARROW_OUT = pa.schema(
    [
        ("file_path", pa.string()),
        ("module", pa.string()),
        ("content_hash", pa.string()),
        ("ok", pa.bool_()),
        ("symbols", pa.list_(_ARROW_SYMBOL)),
        ("raw_edges", pa.list_(_ARROW_EDGE)),
    ]
)

_LONE_SURROGATE = re.compile("[\ud800-\udfff]")

# Source text whose rows go out together.
BATCH_CHARS = 4 * 1024 * 1024


def _dotted(node: ast.AST) -> str | None:
    """``a.b.c`` for a chain of attributes on a plain name, None for anything else."""
    attributes: list[str] = []
    while isinstance(node, ast.Attribute):
        attributes.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(attributes)])


def _summary(node: ast.AST) -> str:
    doc = ast.get_docstring(node)
    # an escape in a docstring can make half of a surrogate pair, which no table can hold
    return _LONE_SURROGATE.sub("\ufffd", doc.splitlines()[0]) if doc else ""


def scan_python(path: str, module: str, text: str) -> tuple[list[dict], set[tuple[str, str, str]]]:
    """Symbols in depth-first order and the set of raw edges of one Python file.

    Raises SyntaxError, ValueError, RecursionError or MemoryError for a file that does not parse.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        tree = ast.parse(text)
    symbols: list[dict] = []
    edges: set[tuple[str, str, str]] = set()

    def emit(name: str, qualified: str, kind: str, first: int, last: int, summary: str = "", extra: dict | None = None):
        symbols.append(
            {
                "name": name,
                "qualified_name": qualified,
                "kind": kind,
                "file_path": path,
                "line_start": first,
                "line_end": last,
                "summary": summary,
                "raw_signature": "",
                "extra": list((extra or {}).items()),
                "ordinal": len(symbols),
            }
        )

    # Work list instead of recursion: (node, qualified name of the enclosing scope, is that the module, inside a class)
    todo = [(tree, module, True, False)]
    while todo:
        node, scope, top, in_class = todo.pop()
        match node:
            case ast.ClassDef():
                scope, top, in_class = f"{scope}.{node.name}", False, True
                emit(node.name, scope, "class", node.lineno, node.end_lineno, _summary(node))
                edges.update((scope, base, "inherits") for base in map(_dotted, node.bases) if base)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                scope, top = f"{scope}.{node.name}", False
                kind = "method" if in_class else "function"
                emit(node.name, scope, kind, node.lineno, node.end_lineno, _summary(node))
            case ast.Import() | ast.ImportFrom():
                plain = isinstance(node, ast.Import)
                # a purely relative import names no module and leaves no trace
                for alias in node.names if plain or node.module else ():
                    source = alias.name if plain else node.module
                    shown = alias.asname or alias.name
                    where = f"{scope}.__import__.{node.lineno}.{node.col_offset}.{source}.{shown}"
                    extra = {"module": source} if plain else {"module": source, "original_name": alias.name}
                    emit(shown, where, "import", node.lineno, node.end_lineno, extra=extra)
                    edges.add((module, source if plain else f"{source}.{alias.name}", "imports"))
            case ast.Call():
                callee = _dotted(node.func)
                if callee and not top:
                    edges.add((scope, callee, "calls"))
        todo.extend((child, scope, top, in_class) for child in reversed(list(ast.iter_child_nodes(node))))
    emit(path.rsplit("/", 1)[-1], module, "file", 1, len(text.splitlines()))
    return symbols, edges


def _parses(path: str, module: str, text: str) -> tuple[list[dict], set[tuple[str, str, str]]] | None:
    """What ``scan_python`` finds, None for a file that does not parse.

    The parser reports nesting beyond its stack as a memory error of its own; one of the task itself is not about the file.
    """
    try:
        return scan_python(path, module, text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    except MemoryError as error:
        if "Parser stack overflowed" in str(error):
            return None
        raise


def python_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for path, module, text, content_hash in zip(*(c.to_pylist() for c in map(batch.column, ("file_path", "module", "text", "content_hash")))):
            found = _parses(path, module, text)
            symbols, edges = found or ([], set())
            rows.append(
                {
                    "file_path": path,
                    "module": module,
                    "content_hash": content_hash,
                    "ok": found is not None,
                    "symbols": symbols,
                    "raw_edges": [dict(zip(EDGES.names, edge)) for edge in sorted(edges)],
                }
            )
            size += len(text)
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_OUT)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_OUT)


@dataclass(frozen=True)
class Extractor:
    """A file handler: which paths it takes, and its Arrow-batch body.

    The body gets ``file_path, module, text, content_hash`` and returns the ``EXTRACTED`` columns; hash and module go through
    it, so that what is stored about a file comes from one read.
    """

    name: str
    accepts: Callable[[Column], Column]
    body: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


PYTHON = Extractor("python", lambda path: F.endswith(path, F.lit(".py")), python_batches)


def extract(
    files: DataFrame, extractors: Sequence[Extractor] = (PYTHON,), strip_prefix: str | None = None
) -> DataFrame:
    """``file_path, text[, content_hash]`` -> one row per handled file: the ``EXTRACTED`` columns.

    The first extractor that accepts a path handles it. ``symbols`` keeps duplicates, ``raw_edges`` is
    a set already. Rows are whole files; a body gets them in Arrow batches and gives out bounded ones.
    """
    path = F.col("file_path")
    content_hash = F.col("content_hash") if "content_hash" in files.columns else F.lit(None).cast("string")
    source = files.select("file_path", module_path(path, strip_prefix).alias("module"), "text", content_hash.alias("content_hash"))
    chosen = dispatch(path, [(e.name, e.accepts(path)) for e in extractors])
    parts = [source.filter(chosen == e.name).mapInArrow(e.body, EXTRACTED) for e in extractors]
    return reduce(DataFrame.unionByName, parts)


def symbols_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.inline("symbols"))


def raw_edges_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("file_path", F.inline("raw_edges"))


def rejects_of(extracted: DataFrame) -> DataFrame:
    """Files that did not parse: they have a file row but no symbols and no edges."""
    return extracted.filter(~F.col("ok")).select("file_path")
