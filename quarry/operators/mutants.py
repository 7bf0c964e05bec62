"""Mutants of function bodies: one changed line each, for measuring test selections."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: The operators in their order, with swaps tried left to right.
SWAPS = {
    "boolean-flip": {"true": "false", "false": "true", "True": "False", "False": "True"},
    "comparison-swap": {"===": "!==", "!==": "===", "==": "!=", "!=": "==", "<=": ">", ">=": "<", "<": ">=", ">": "<="},
    "arithmetic-swap": {"+": "-", "-": "+", "*": "/", "/": "*"},
}
MOST = 25
_COMMENT = ("#", "//", "*", "/*")
_DEFINITION = re.compile(r"^\s*(?:export\s+|pub\s+|async\s+|default\s+)*(?:def|class|function|fn|func|interface|struct|enum|trait|impl|import|from|@)\b")


def _quoted(line: str) -> list[bool]:
    out, quote = [], ""
    for i, c in enumerate(line):
        if quote:
            out.append(True)
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        else:
            quote = c if c in "\"'`" else ""
            out.append(bool(quote))
    return out


def mutate_line(line: str, python: bool) -> list[tuple[str, str]]:
    """(operator, changed line): at most one change an operator, outside quotes."""
    if not line.strip() or line.strip().startswith(_COMMENT) or _DEFINITION.match(line):
        return []
    out, inside = [], _quoted(line)
    patterns = {"boolean-flip": r"\b(?:true|false|True|False)\b", "comparison-swap": r"===|!==|==|!=|(?<![<=>-])<=|(?<![<=>-])>=|(?<= )<(?= )|(?<= )>(?= )", "arithmetic-swap": r"(?<=[\w)\]] )[-+*/](?= [\w(])"}
    for op, swaps in SWAPS.items():
        m = next((m for m in re.finditer(patterns[op], line) if not inside[m.start()]), None)
        if m:
            out.append((op, line[: m.start()] + swaps[m[0]] + line[m.end() :]))
    neutral = "None" if python else "null"
    m = re.match(r"^(\s*return\s+)([^;]+?)(\s*;?\s*)$", line)
    if m and m[2] != neutral:
        out.append(("return-empty", m[1] + neutral + m[3]))
    m = re.match(r"^(\s*)((?:await\s+)?[\w$.]+\(.*\)\s*;?)\s*$", line)
    if m and not m[2].startswith(("return", "if", "for", "while")):
        out.append(("remove-call", m[1] + ("# " if python else "// ") + m[2]))
    m = next((m for m in re.finditer(r"(?<![\w.])\d+(?![\w.])", line) if not inside[m.start()]), None)
    if m:
        out.append(("off-by-one", line[: m.start()] + str(int(m[0]) + 1) + line[m.end() :]))
    return [(op, new) for op, new in out if new != line]


def mutants(bodies: DataFrame, most: int = MOST) -> DataFrame:
    """(id, op, line, original, mutated): the first ``most`` of each body, by line and operator.

    ``bodies`` has id, language, body; a null body has none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, language, body in zip(b["id"], b["language"], b["body"], strict=True):
                found = [(key, op, n, line, new) for n, line in enumerate((body or "").split("\n"), 1) for op, new in mutate_line(line, language == "python")]
                rows += found[:most]
            yield pd.DataFrame(rows, columns=["id", "op", "line", "original", "mutated"])

    return bodies.select("id", "language", "body").mapInPandas(run, "id string, op string, line int, original string, mutated string")


def apply_mutant(body: str, line: int, original: str, mutated: str) -> str:
    """The body with one line replaced; refuses if the line is not the original."""
    lines = body.split("\n")
    if not 0 < line <= len(lines) or lines[line - 1] != original:
        raise ValueError("the body has changed since the mutant was made")
    lines[line - 1] = mutated
    return "\n".join(lines)
