"""Source files to entities and raw edges: a scan, a scope filter and a parser behind one Arrow-batched map."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintain import in_file_scope
from .scanners import FAMILY, scan_astro, scan_braces

RECORD = "record string, file string, name string, qualified_name string, kind string, range_start int, range_end int, arity int, params array<string>, return_type string, visibility string, src_name string, dst_name string, edge_kind string, receiver string, receiver_chain array<string>, imported string, local string, line int, col int, ast_hash string"
FIELDS = [f.split(" ")[0] for f in RECORD.split(", ")]


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(file, text, size) of the indexable files under ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    file = F.expr(f"substring(path, locate('{root}', path) + {len(root.rstrip('/')) + 1})")
    return raw.select(file.alias("file"), F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size")).where(in_file_scope(F.col("file"), F.col("size")))


class _Python(ast.NodeVisitor):
    """Definitions, calls and imports of one module, in source order."""

    def __init__(self, file: str, text: str) -> None:
        self.file, self.text, self.rows, self.stack = file, text, [], []

    def row(self, record: str, **values: object) -> None:
        self.rows.append({"record": record, "file": self.file} | values)

    def define(self, node: ast.AST, kind: str) -> None:
        name = node.name
        qualified = ".".join([*(n for n, _ in self.stack), name])
        more: dict = {}
        if kind != "class":
            a = node.args
            params = [p.arg for p in [*a.posonlyargs, *a.args, *a.kwonlyargs]]
            params = params[1:] if kind == "method" and params[:1] in (["self"], ["cls"]) else params
            more = {"arity": len(params), "params": params, "return_type": ast.unparse(node.returns) if node.returns else None}
        visibility = "private" if name.startswith("_") and not name.startswith("__") else "public"
        body = ast.get_source_segment(self.text, node) or ""
        self.row("node", name=name, qualified_name=qualified, kind=kind, range_start=node.lineno, range_end=node.end_lineno, visibility=visibility, ast_hash=hashlib.sha256(body.encode()).hexdigest(), **more)
        self.stack.append((name, kind))
        self.generic_visit(node)
        self.stack.pop()

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.define(node, "class")

    def visit_FunctionDef(self, node: ast.FunctionDef) -> None:
        self.define(node, "method" if self.stack and self.stack[-1][1] == "class" else "function")

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Call(self, node: ast.Call) -> None:
        chain, f = [], node.func
        while isinstance(f, ast.Attribute):
            chain.append(f.attr)
            f = f.value
        if isinstance(f, ast.Name):
            chain.append(f.id)
        if chain:
            chain.reverse()
            src = ".".join(n for n, _ in self.stack) or self.file
            self.row("edge", src_name=src, dst_name=chain[-1], edge_kind="static_call", receiver=chain[-2] if len(chain) > 1 else None, receiver_chain=chain[:-1], line=node.lineno, col=node.col_offset + 1)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.row("edge", src_name=self.file, dst_name=a.name, edge_kind="import", imported=a.asname or a.name.split(".")[0], local=a.asname or a.name.split(".")[0], line=node.lineno, col=node.col_offset + 1)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        base = "." * node.level + (node.module or "")
        for a in node.names:
            self.row("edge", src_name=self.file, dst_name=base, edge_kind="import", imported=a.name, local=a.asname or a.name, line=node.lineno, col=node.col_offset + 1)


def _module(file: str, text: str) -> dict:
    stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    lines = max(1, text.count("\n") + (not text.endswith("\n")))
    return {"record": "node", "file": file, "name": stem, "qualified_name": "", "kind": "module", "range_start": 1, "range_end": lines, "ast_hash": hashlib.sha256(text.encode()).hexdigest()}


def parse_python(file: str, text: str) -> list[dict]:
    """The module record first, then definitions and edges; a syntax error gives one warning record."""
    try:
        v = _Python(file, text)
        v.visit(ast.parse(text))
        return [_module(file, text), *v.rows]
    except (SyntaxError, ValueError, RecursionError) as e:
        return [_module(file, text), {"record": "warning", "file": file, "line": getattr(e, "lineno", None) or 1}]


def parse(file: str, text: str) -> list[dict]:
    """Records of a file of any known language."""
    ending = file.rsplit(".", 1)[-1].lower()
    if ending == "py":
        return parse_python(file, text)
    rows = scan_astro(file, text) if ending == "astro" else scan_braces(file, text, FAMILY[ending]) if ending in FAMILY else []
    return [_module(file, text), *rows]


def extract(files: DataFrame) -> DataFrame:
    """Records of every file (file, text); a null text gives none, an unknown language only its module."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for f, t in zip(b["file"], b["text"], strict=True) if t is not None for r in parse(f, t)]
            out = pd.DataFrame(rows, columns=FIELDS).astype(object)
            yield out.where(out.notna(), None)

    return files.select("file", "text").mapInPandas(run, RECORD)


def read_records(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Newline-delimited JSON records; a malformed line is kept as null fields, or fails the read."""
    return spark.read.schema(RECORD).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
