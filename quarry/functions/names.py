"""Identifier and runtime-name functions, test classification: column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Path fragments and leading directories that mark a test file.
TEST_PATHS = ["/test/", "/tests/", "/__tests__/", "_test.", "test_", ".test.", ".spec.", "_spec."]
TEST_DIRS = ["test/", "tests/", "__tests__/"]
#: Paths of test, benchmark and mock files; * is any run, letters without case.
TEST_GLOBS = ["*.test.*", "*.spec.*", "__tests__/*", "*/__tests__/*", "*_test.*", "*_spec.rb", "test_*.py", "*/test_*.py", "tests/*", "*/tests/*", "test/*", "*/test/*"]
BENCH_GLOBS = ["bench/*", "*/bench/*"]
MOCK_GLOBS = ["*/mocks.*", "mocks.*", "*.mock.*", "*/mocks/*", "*/__mocks__/*"]
#: Segments of a runtime name's hint that are file extensions.
HINT_EXTENSIONS = ["ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts", "py", "rs", "go"]
#: Glue words that a relaxed search drops.
STOP_WORDS = (
    "a an the this that these those it its how what why when where which who whom whose is are was were be been being am "
    "do does did done has have had can could will would shall should may might must and or but nor so if then than because "
    "of to in on at for from by with without into onto over under about after before between through during as up down out off "
    "we us our you your they them their i me my he she him her stops stop happens happen work works same two one some any all each every there here"
).split()
#: Words that claim intents and scopes share without meaning.
INTENT_STOP_WORDS = (
    "the and for with add adding fix fixing update updating refactor refactoring into from this that make use using support "
    "handle handling new old via onto over under when while then than also"
).split()
#: Abbreviations and what they stand for; every member of a group suggests the others.
ABBREVIATIONS = [
    ["auth", "authentication"], ["authn", "authentication"], ["authz", "authorization"], ["db", "database"], ["cfg", "config", "configuration"],
    ["msg", "message"], ["btn", "button"], ["idx", "index"], ["req", "request"], ["res", "resp", "response"], ["err", "error"],
    ["init", "initialize"], ["util", "utility"], ["repo", "repository"], ["ctx", "context"], ["fn", "func", "function"], ["val", "value"],
    ["arg", "argument"], ["impl", "implementation"], ["dir", "directory"], ["doc", "document"],
]
#: File extensions and their languages.
LANGUAGES = {
    "python": ["py"], "typescript": ["ts", "cts", "mts"], "tsx": ["tsx"], "javascript": ["js", "mjs", "cjs", "jsx"], "rust": ["rs"], "go": ["go"], "astro": ["astro"],
}


def identifier_tokens(term: Column, least: int = 2) -> Column:
    """Lower-cased subtokens at case, digit and punctuation boundaries."""
    spaced = F.regexp_replace(term, r"[^\p{L}\p{N}]+", " ")
    for pattern in (r"([\p{Ll}\p{N}])(\p{Lu})", r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    return F.filter(F.transform(F.split(spaced, r"\s+"), F.lower), lambda t: F.length(t) >= least)


def expand_terms(terms: list[str], most: int = 6) -> list[list[str]]:
    """Query terms as OR-groups: each with its subtokens and abbreviation partners."""
    import re

    groups = []
    for term in terms:
        spaced = re.sub(r"[\W_]+", " ", term)
        for pattern in (r"([a-z0-9])([A-Z])", r"([A-Z]+)([A-Z][a-z])", r"([^\W\d_])(\d)", r"(\d)([^\W\d_])"):
            spaced = re.sub(pattern, r"\1 \2", spaced)
        parts = [p.lower() for p in spaced.split() if len(p) > 1 and p.lower() != term.lower()]
        partners = [o for p in [term.lower(), *parts] for g in ABBREVIATIONS if p in g for o in g if o != p]
        added = list(dict.fromkeys(x for x in parts + partners if x != term.lower()))[:most]
        groups.append([term, *added])
    return groups


def sanitize_terms(query: str, most: int = 32) -> list[str]:
    """Terms of a search string: letters, digits and underscores; distinct without case, at most 32."""
    import re

    seen: dict[str, str] = {}
    for raw in query.split():
        term = re.sub(r"[^\w]", "", raw)
        if term:
            seen.setdefault(term.lower(), term)
    return list(seen.values())[:most]


def test_file(file: Column) -> Column:
    path = F.replace(F.coalesce(file, F.lit("")), F.lit("\\"), F.lit("/"))
    hit = F.lit(False)
    for d in TEST_DIRS:
        hit = hit | path.startswith(d)
    for p in TEST_PATHS:
        hit = hit | path.contains(p)
    return hit


#: The test names of each language's runners.
TEST_NAMES = {
    "python": r"^test_|^Test[A-Z0-9_]|^Test$",
    "javascript": r"^test[A-Z_]|(?:Test|Spec)$",
    "go": r"^(?:Test|Benchmark|Example|Fuzz)([A-Z0-9_]|$)",
    "rust": r"^test_|_test",
}


def leaf(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.]*)$", 1)


def test_name(name: Column) -> Column:
    """A test by name in any language: the whole name or its last segment."""
    rule = "|".join(TEST_NAMES.values())
    return name.rlike(rule) | leaf(name).rlike(rule)


def _globbed(file: Column, globs: list[str]) -> Column:
    path, out = F.coalesce(file, F.lit("")), F.lit(False)
    for g in globs:
        out = out | path.ilike(g.replace("_", r"\_").replace("*", "%"))
    return out


def test_path(file: Column) -> Column:
    """A test file to packs and search ranking; narrower than what a runner may select (``test_file``)."""
    return _globbed(file, TEST_GLOBS)


def scaffold_path(file: Column) -> Column:
    """A test, benchmark or mock file."""
    return _globbed(file, TEST_GLOBS + BENCH_GLOBS + MOCK_GLOBS)


def is_test(file: Column, name: Column) -> Column:
    return test_file(file) | test_name(name)


def extension(file: Column) -> Column:
    base = F.regexp_extract(file, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^.+\.([^.]*)$", 1))


def language(file: Column) -> Column:
    ext, out = extension(file), F.lit(None).cast("string")
    for name, exts in LANGUAGES.items():
        out = F.when(ext.isin(exts), name).otherwise(out)
    return out


def runner(file: Column) -> Column:
    """The test runner of a file by its extension; jest only where the path says so."""
    ext = extension(file)
    js = ext.isin("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
    jest = F.replace(file, F.lit("\\"), F.lit("/")).contains("jest")
    return F.when(ext == "py", "pytest").when(js, F.when(jest, "jest").otherwise("vitest")).when(ext == "go", "go").when(ext == "rs", "cargo").otherwise("unknown")


def _pytest_file(file: Column) -> Column:
    return F.regexp_extract(file, r"([^/]*)$", 1).rlike(r"^test_.*\.py$|_test\.py$")


def collectable(file: Column, name: Column, id_: Column) -> Column:
    """Whether pytest would collect the entity by a node id of its own.

    The file is a test module, nothing is nested in a function, a qualifier is a class named Test*, and the last segment is test* or Test*.
    """
    tail = F.regexp_extract(id_, r"([^/]*)$", 1)
    nested = name.contains(".<locals>.") | id_.contains(".<locals>.")
    owner = lambda q: F.regexp_extract(q, r"([^.]*)\.[^.]*$", 1)
    qualified = lambda q: q.rlike(r"^.+\.")
    helper = (qualified(name) & ~owner(name).rlike("^Test")) | (qualified(tail) & ~owner(tail).rlike("^Test"))
    qual = F.when(name.contains("."), name).when(tail.contains("."), tail).otherwise(name)
    bare = (leaf(name) == "test") | (leaf(tail) == "test")
    return (file.isNull() | _pytest_file(file)) & ~nested & ~bare & ~helper & leaf(qual).rlike("^[tT]est")


def runnable(file: Column, name: Column, id_: Column, kind: Column) -> Column:
    """The handle by which a test's runner selects it: a pytest node id, a Go file::Test, else the file; null if it can't run alone."""
    r = runner(file)
    tail = F.regexp_extract(id_, r"([^/]*)$", 1)
    qual = F.when(name.contains("."), name).when(tail.contains("."), tail).otherwise(name)
    cls = F.regexp_extract(qual, r"([^.]*)\.[^.]*$", 1)
    node = F.when(cls.rlike("^[A-Z]"), F.concat(file, F.lit("::"), cls, F.lit("::"), leaf(qual))).otherwise(F.concat(file, F.lit("::"), name))
    pytest = F.when(kind == "module", F.when(_pytest_file(file), file)).when(collectable(file, name, id_), node)
    go = F.when((kind != "module") & leaf(name).rlike(TEST_NAMES["go"]), F.concat(file, F.lit("::"), leaf(name))).otherwise(file)
    return F.when(file.isNull(), None).when(r == "pytest", pytest).when(r == "go", go).otherwise(file)


def runtime_segments(name: Column, depth: int = 4) -> Column:
    """A runtime name's segments: pointer receivers and generics stripped, split on ``::``, ``.``, ``:`` and ``/``."""
    plain = F.regexp_replace(name, r"\(\*([^)]*)\)", "$1")
    for _ in range(depth):
        plain = F.regexp_replace(plain, r"<[^<>]*>|\[[^\[\]]*\]", "")
    return F.filter(F.split(plain, r"::|[.:/]"), lambda s: s != "")


def fnv1a(text: Column, offset: int = 0x811C9DC5, prime: int = 0x01000193) -> Column:
    """32-bit FNV-1a over the text's UTF-16 units, as 8 hex digits; the product is taken in halves, so 64 bits hold it."""
    digits = F.hex(F.encode(text, "UTF-16BE"))
    n = (F.length(digits) / 4).cast("int")
    units = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(digits, i * 4 - 3, F.lit(4)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    mask = F.lit(0xFFFFFFFF)

    def step(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        high = F.shiftleft((x * F.lit(prime >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
        return (high + x * F.lit(prime & 0xFFFF)).bitwiseAND(mask)

    return F.lpad(F.lower(F.hex(F.aggregate(units, F.lit(offset).cast("long"), step))), 8, "0")


def entity_id(file: Column, qualified: Column, is_method: Column) -> Column:
    """scope/module/qualified: the directory verbatim, the file's stem (or its directory for package files)."""
    directory = F.regexp_extract(file, r"^(.*)/[^/]*$", 1)
    base = F.regexp_extract(file, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    package = base.isin("__init__.py", "mod.rs", "lib.rs", "main.rs")
    module = F.when(package & (directory != ""), F.regexp_extract(directory, r"([^/]*)$", 1)).otherwise(stem)
    scope = F.when(directory == "", "").otherwise(F.concat(directory, F.lit("/")))
    qn = F.trim(qualified)
    qn = F.when(~is_method & qn.startswith(F.concat(module, F.lit("."))), F.regexp_replace(qn, r"^[^.]*\.", "")).otherwise(qn)
    return F.when(qn == "", F.concat(scope, module)).otherwise(F.concat(scope, module, F.lit("/"), qn))
