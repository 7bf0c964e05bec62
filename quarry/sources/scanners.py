"""Definitions, calls and imports of brace languages, by a line scanner over comment-free text.

A subset of a real parser: declarations are recognised by keyword patterns, bodies by balanced
braces, calls by a name before a parenthesis. Records have the fields of ``code.RECORD``.
"""

from __future__ import annotations

import hashlib
import re

#: Keyword patterns of declarations; group ``n`` is the name.
DECLARATIONS = {
    "typescript": [
        ("class", r"\b(?:abstract\s+)?class\s+(?P<n>[A-Za-z_$][\w$]*)"),
        ("interface", r"\binterface\s+(?P<n>[A-Za-z_$][\w$]*)"),
        ("enum", r"\benum\s+(?P<n>[A-Za-z_$][\w$]*)"),
        ("type", r"\btype\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?\s*="),
        ("function", r"\bfunction\s*\*?\s*(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\((?P<p>[^)]*)\)"),
        ("function", r"\b(?:const|let|var)\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?::[^=]*)?=\s*(?:async\s*)?\((?P<p>[^)]*)\)\s*(?::[^=]*)?=>"),
        ("member", r"^\s*(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?P<n>[A-Za-z_$#][\w$]*)\s*(?:<[^(]*>)?\((?P<p>[^)]*)\)\s*(?::[^{;]*)?\{"),
    ],
    "rust": [
        ("scope", r"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>[A-Za-z_]\w*)"),
        ("struct", r"\bstruct\s+(?P<n>[A-Za-z_]\w*)"),
        ("enum", r"\benum\s+(?P<n>[A-Za-z_]\w*)"),
        ("trait", r"\btrait\s+(?P<n>[A-Za-z_]\w*)"),
        ("type", r"\btype\s+(?P<n>[A-Za-z_]\w*)"),
        ("function", r"\bfn\s+(?P<n>[A-Za-z_]\w*)\s*(?:<[^(]*>)?\((?P<p>[^)]*)\)"),
    ],
    "go": [
        ("receiver", r"^func\s+\(\s*\w*\s*\*?(?P<r>[A-Za-z_]\w*)[^)]*\)\s*(?P<n>[A-Za-z_]\w*)\s*\((?P<p>[^)]*)\)"),
        ("function", r"^func\s+(?P<n>[A-Za-z_]\w*)\s*(?:\[[^\]]*\])?\((?P<p>[^)]*)\)"),
        ("struct", r"^type\s+(?P<n>[A-Za-z_]\w*)\s+struct\b"),
        ("interface", r"^type\s+(?P<n>[A-Za-z_]\w*)\s+interface\b"),
        ("type", r"^type\s+(?P<n>[A-Za-z_]\w*)\s"),
    ],
}
IMPORTS = {
    "typescript": [r"\bimport\b[^'\"]*['\"](?P<m>[^'\"]+)['\"]", r"\bexport\b[^'\"]*\bfrom\s*['\"](?P<m>[^'\"]+)['\"]", r"\brequire\(\s*['\"](?P<m>[^'\"]+)['\"]"],
    "rust": [r"^\s*(?:pub\s+)?use\s+(?P<m>[\w:]+)", r"^\s*(?:pub\s+)?mod\s+(?P<m>\w+)\s*;"],
    "go": [r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"(?P<m>[^\"]+)\"\s*$"],
}
#: Words before a parenthesis that are no calls.
KEYWORDS = set("if for while switch catch return function match fn func new await typeof super constructor else do in of loop defer go select case yield".split())
CALL = re.compile(r"([A-Za-z_$][\w$]*(?:(?:\.|::|\?\.)[A-Za-z_$][\w$]*)*)\s*(?:::<[^(]*>)?\(")
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
FAMILY = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "typescript", "jsx": "typescript", "mjs": "typescript", "cjs": "typescript", "rs": "rust", "go": "go"}


def _blank(text: str) -> str:
    """The text with comments and string contents as blanks, lines and columns kept."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _parameters(raw: str | None, family: str) -> list[str]:
    parts = [p.strip() for p in (raw or "").split(",") if p.strip()]
    if family == "go":
        names = [p.split()[0] for p in parts]
    else:
        names = [re.split(r"[:=?\s]", p.removeprefix("mut ").lstrip("&."))[0] for p in parts]
    return [n for n in names if n not in ("self", "mut")]


def _visibility(line: str, name: str, family: str) -> str:
    if family == "go":
        return "public" if name[:1].isupper() else "private"
    if family == "rust":
        return "public" if re.search(r"\bpub\b", line) else "private"
    return "private" if name.startswith(("#", "_")) or re.search(r"\bprivate\b", line) else "public"


def scan_braces(file: str, text: str, family: str) -> list[dict]:
    """Definition and edge records of one file, in source order."""
    clean = _blank(text)
    separator = "::" if family == "rust" else "."
    rows, open_, depth = [], [], 0
    lines = clean.split("\n")
    source = text.split("\n")
    for number, line in enumerate(lines, 1):
        for pattern in IMPORTS[family]:
            for m in re.finditer(pattern, source[number - 1]):
                if lines[number - 1][m.start() : m.end()].strip():
                    rows.append({"record": "edge", "file": file, "src_name": file, "dst_name": m["m"], "edge_kind": "import", "line": number, "col": m.start() + 1})
        named = set()
        for kind, pattern in DECLARATIONS[family]:
            m = re.search(pattern, line)
            if not m or m["n"] in named or (kind == "member" and (m["n"] in KEYWORDS - {"constructor"} or not open_ or open_[-1]["kind"] != "class")):
                continue
            named.add(m["n"])
            holders = [o["name"] for o in open_]
            if kind == "receiver":
                holders, kind = [m["r"]], "method"
            elif kind == "member" or (kind == "function" and open_ and open_[-1]["kind"] in ("class", "scope", "trait", "interface")):
                kind = "method"
            node = {"record": "node", "file": file, "name": m["n"], "qualified_name": separator.join([*holders, m["n"]]), "kind": kind, "range_start": number, "range_end": number, "visibility": _visibility(line, m["n"], family)}
            if kind in ("function", "method"):
                node |= {"params": _parameters(m["p"], family), "arity": len(_parameters(m["p"], family))}
            if kind != "scope":
                rows.append(node)
            open_.append(node | {"depth": depth, "entered": False, "row": node})
        inside = next((o for o in reversed(open_) if o["kind"] in ("function", "method")), None)
        for m in CALL.finditer(line):
            chain = re.split(r"\?\.|\.|::", m[1])
            if chain[-1] in KEYWORDS or chain[-1] in named or chain[0] in ("fn", "func"):
                continue
            rows.append({"record": "edge", "file": file, "src_name": inside["qualified_name"] if inside else file, "dst_name": chain[-1], "edge_kind": "static_call", "receiver": chain[-2] if len(chain) > 1 else None, "receiver_chain": chain[:-1], "line": number, "col": m.start() + 1})
        for c in line:
            if c == "{":
                depth += 1
                for o in open_:
                    o["entered"] |= depth > o["depth"]
            elif c == "}":
                depth -= 1
        while open_ and ((open_[-1]["entered"] and depth <= open_[-1]["depth"]) or (not open_[-1]["entered"] and line.rstrip().endswith(";"))):
            done = open_.pop()
            done["row"]["range_end"] = number
            body = "\n".join(source[done["range_start"] - 1 : number])
            done["row"]["ast_hash"] = hashlib.sha256(body.encode()).hexdigest()
    return rows


def scan_astro(file: str, text: str) -> list[dict]:
    """The frontmatter as TypeScript; components of the template are calls."""
    m = re.match(r"\s*---\n(.*?)\n---", text, re.S)
    rows = scan_braces(file, m[1], "typescript") if m else []
    before = text[: m.start(1)].count("\n") if m else 0
    for r in rows:
        for k in ("range_start", "range_end", "line"):
            if r.get(k):
                r[k] += before
    start = m.end() if m else 0
    for t in re.finditer(r"<([A-Z][\w.]*)", text[start:]):
        at = start + t.start()
        rows.append({"record": "edge", "file": file, "src_name": file, "dst_name": t[1].split(".")[-1], "edge_kind": "static_call", "receiver_chain": t[1].split(".")[:-1], "line": text.count("\n", 0, at) + 1, "col": at - text.rfind("\n", 0, at)})
    return rows
