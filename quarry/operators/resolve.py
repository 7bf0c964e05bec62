"""Name, import and runtime-name resolution: joins on pre-aggregated, unique keys, so ambiguity never fans out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import HINT_EXTENSIONS, runtime_segments


def unique_index(nodes: DataFrame, *keys: str) -> DataFrame:
    """Keys that name one node: (keys, target); ambiguous keys are absent."""
    return nodes.groupBy(*keys).agg(F.count_distinct("id").alias("n"), F.min("id").alias("target")).where("n = 1").drop("n")


def resolve_names(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """raw (file, name) to target: same file's name, else the package's only one, else ``?:name``."""
    local = unique_index(nodes, "file", "name").withColumnRenamed("target", "local")
    package = unique_index(nodes, "package", "name").withColumnRenamed("target", "global")
    r = raw.join(local, ["file", "name"], "left").join(package, ["package", "name"], "left")
    return r.withColumn("target", F.coalesce("local", "global", F.concat(F.lit("?:"), "name"))).drop("local", "global")


def retry_unresolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Dangling call edges retried by unique name; self-loops stay dangling."""
    index = unique_index(nodes, "name").select(F.concat(F.lit("?:"), "name").alias("dst"), "target")
    e = edges.join(index, "dst", "left")
    ok = F.col("target").isNotNull() & (F.col("kind") != "import") & (F.col("target") != F.col("src"))
    return e.withColumn("dst", F.when(ok, F.col("target")).otherwise(F.col("dst"))).drop("target").groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def resolve_runtime(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """(raw, id): the node that a runtime name means, or null where that is not certain.

    The last two segments as a qualified name, then the last three, then the last as a bare name. A key of one node is that node; of several, the
    segments before are a hint: candidates score by the longest end of the hint that stands in their id, then by how many of
    the id's segments the hint holds. A single best with any score wins, a tie or none leaves the name open. Endings of files are no hint.
    """
    n = names.select("raw").distinct().withColumn("s", runtime_segments(F.col("raw")))
    size = F.size("s")
    level = lambda k, of: F.struct(F.lit(k).alias("level"), F.array_join(F.slice("s", F.greatest(size - of + 1, F.lit(1)), of), ".").alias("key"), F.slice("s", 1, F.greatest(size - of, F.lit(0))).alias("hint"))
    keys = F.array(F.when(size >= 2, level(2, 2)), F.when(size >= 3, level(3, 3)), F.when(size >= 1, level(9, 1)))
    k = n.select("raw", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("k")).select("raw", "k.level", "k.key", F.filter("k.hint", lambda h: ~h.isin(HINT_EXTENSIONS)).alias("hint"))
    by = nodes.select(F.col("qualified_name").alias("key"), "id", F.lit(True).alias("qualified")).union(nodes.select("name", "id", F.lit(False)))
    c = k.join(by, "key").where((F.col("level") < 9) == F.col("qualified")).withColumn("path", runtime_segments(F.col("id")))
    lengths = F.sequence(F.lit(1), F.greatest(F.size("hint"), F.lit(1)))
    tail = lambda n_: F.slice("hint", F.greatest(F.size("hint") - n_ + 1, F.lit(1)), n_)
    stands = lambda n_: (n_ <= F.size("hint")) & F.exists(F.sequence(F.lit(1), F.greatest(F.size("path"), F.lit(1))), lambda i: F.slice("path", i, n_) == tail(n_))
    run = F.coalesce(F.array_max(F.filter(lengths, stands)), F.lit(0))
    shared = F.size(F.filter("path", lambda x: F.array_contains("hint", x)))
    c = c.select("raw", "level", "id", run.alias("run"), shared.alias("shared"))
    w, order = Window.partitionBy("raw", "level"), Window.partitionBy("raw", "level").orderBy(F.col("run").desc(), F.col("shared").desc())
    c = c.withColumn("n", F.count("*").over(w)).withColumn("r", F.rank().over(order)).where("r = 1")
    best = c.groupBy("raw", "level").agg(F.count("*").alias("tied"), F.max("n").alias("n"), F.min("id").alias("id"), F.max(F.col("run") + F.col("shared")).alias("score"))
    best = best.where("n = 1 or (tied = 1 and score > 0)").groupBy("raw").agg(F.min_by("id", "level").alias("id"))
    return names.select("raw").distinct().join(best, "raw", "left")


def normal_path(path: Column) -> Column:
    """POSIX normalisation of ``.`` and ``..``."""
    parts = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    out = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == "..", acc).otherwise(F.array_append(acc, s)))
    return F.array_join(out, "/")


#: Endings tried in order when a relative import names no file.
ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier) to the first existing candidate path, or null."""
    directory = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    base = normal_path(F.concat(directory, F.lit("/"), "specifier"))
    c = imports.select("file", "specifier", F.posexplode(F.array(*[F.concat(base, F.lit(e)) for e in ENDINGS])).alias("p", "path"))
    hit = c.join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("file", "specifier").agg(F.min_by("path", "p").alias("target"))
    return imports.join(hit, ["file", "specifier"], "left")


def resolve_dotted(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(specifier) to the longest dotted prefix that is a module, and the symbol after it."""
    parts = F.split("specifier", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("i"), F.array_join(F.slice(parts, 1, i), ".").alias("module")))
    c = imports.select("specifier", F.explode(prefixes).alias("p")).select("specifier", "p.i", "p.module")
    hit = c.join(modules.select("module").distinct(), "module").groupBy("specifier").agg(F.max_by("module", "i").alias("module"))
    return imports.join(hit, "specifier", "left").withColumn("symbol", F.expr("case when module is not null and length(specifier) > length(module) then substring(specifier, length(module) + 2) end"))


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """Each file's longest package directory, '' if none: an equi-join on the file's directory prefixes."""
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    c = files.select("file", F.explode(dirs).alias("dir"))
    hit = c.join(packages.select("dir").distinct(), "dir").groupBy("file").agg(F.max_by("dir", F.length("dir")).alias("package"))
    return files.join(hit, "file", "left").withColumn("package", F.coalesce("package", F.lit("")))


def resolve_aliases(imports: DataFrame, aliases: DataFrame, files: DataFrame) -> DataFrame:
    """(file, specifier) through path aliases: of the nearest configuration, the pattern with the longest literal start.

    ``aliases`` has dir (of the configuration), pattern and target, each with at most one ``*``. The table
    belongs to the repository's configuration files, not to its code.
    """
    star = F.col("pattern").contains("*")
    lead, tail = F.substring_index("pattern", "*", 1), F.when(star, F.substring_index("pattern", "*", -1)).otherwise("")
    # Every directory above the file and every start of the specifier are keys, so that aliases join by equality.
    parts = F.split("file", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 1, F.lit(0))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    starts = F.transform(F.sequence(F.lit(0), F.length("specifier")), lambda i: F.substring("specifier", F.lit(1), i))
    i = imports.select("file", "specifier").distinct().withColumn("dir", F.explode(dirs)).withColumn("lead", F.explode(starts))
    c = i.join(aliases.withColumn("lead", lead).withColumn("tail", tail), ["dir", "lead"])
    c = c.where(F.when(star, F.col("specifier").endswith(F.col("tail")) & (F.length("specifier") >= F.length("lead") + F.length("tail"))).otherwise(F.col("specifier") == F.col("pattern")))
    middle = F.expr("substring(specifier, length(substring_index(pattern, '*', 1)) + 1, length(specifier) - length(pattern) + 1)")
    path = F.when(star, F.replace("target", F.lit("*"), middle)).otherwise(F.col("target"))
    c = c.select("file", "specifier", F.length("dir").alias("near"), F.length("lead").alias("long"), normal_path(F.concat_ws("/", "dir", path)).alias("base"))
    c = c.select("*", F.posexplode(F.array(*[F.concat("base", F.lit(e)) for e in ENDINGS])).alias("p", "path"))
    hit = c.join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("file", "specifier").agg(F.max_by("path", F.struct("near", "long", -F.col("p"))).alias("target"))
    return imports.join(hit, ["file", "specifier"], "left")


def resolve_workspace(imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(specifier) to a workspace package's file: the longest package name, its entry or the path after its name.

    ``packages`` has name, dir and entry; joined on every prefix of the specifier's segments.
    """
    parts = F.split("specifier", "/")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    c = imports.select("specifier").distinct().select("specifier", F.explode(names).alias("name")).join(packages, "name")
    rest = F.expr("substring(specifier, length(name) + 2)")
    inner = F.array(*[F.concat(F.col("dir"), F.lit(f"/{d}"), rest, F.lit(e)) for d in ("", "src/") for e in ENDINGS])
    entry = F.array(F.concat("dir", F.lit("/"), "entry"), *[F.concat("dir", F.lit(e)) for e in ("/src/index.ts", "/src/index.tsx", "/src/index.js", "/index.ts", "/index.js")])
    c = c.select("specifier", F.length("name").alias("n"), F.posexplode(F.when(rest == "", entry).otherwise(inner)).alias("p", "path"))
    hit = c.join(files.select(F.col("file").alias("path")).distinct(), "path").groupBy("specifier").agg(F.max_by("path", F.struct("n", -F.col("p"))).alias("target"))
    return imports.join(hit, "specifier", "left")
