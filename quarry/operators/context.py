"""Context beyond one symbol's own lines: type references, imported declarations, module frames, packs for changes and for agents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import test_path
from .pack import lines_of, slice_text, tokens_of

#: Type references longer than this are left out, longer than the next cut; declarations and candidate names of imports.
MOST_REF_LINES, SHOWN_REF_LINES, MOST_REFS = 40, 12, 10
MOST_DECLARATION_LINES, MOST_DECLARATIONS = 20, 5
#: Kinds that a type reference may name.
TYPE_KINDS = ["class", "interface", "struct", "enum", "type", "trait"]
#: How a line starts that belongs to the entity below it.
DECORATION = r"^\s*($|//|#|@|/\*|\*)"
#: Words that are never an imported name.
KEYWORDS = (
    "const let var function return if else for while switch case break continue new this super class import export from default typeof instanceof "
    "async await try catch finally throw true false null undefined void in of do extends implements interface type enum public private protected static "
    "readonly def self None True False and or not is lambda pass raise with as yield"
).split()


def imported_files(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, file): the files that the module of each root's file imports, its own and tests left out."""
    own = roots.join(nodes.select(F.col("id").alias("root"), "file"), "root")
    modules = nodes.where("kind = 'module'").select(F.col("id").alias("src"), "file")
    there = nodes.select(F.col("id").alias("dst"), F.col("file").alias("imported"))
    e = edges.where("kind = 'import'").join(modules, "src").join(there, "dst").where("imported is not null and imported <> file")
    e = e.where(~test_path(F.col("imported"))).select("file", "imported").distinct()
    return own.join(e, "file").select("root", F.col("imported").alias("file"))


def words_of(text: Column) -> Column:
    """Distinct identifiers in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z_$][\w$]*"), F.lit(0)))


def type_references(nodes: DataFrame, edges: DataFrame, files: DataFrame, roots: DataFrame, most: int = MOST_REFS) -> DataFrame:
    """(root, id, file, start, end, truncated): types that a root's body names as whole words, of its own file first, then of imported files.

    At most ``most`` a root, by (own file, file, id). Types over 40 lines and those that overlap the root are left out, of longer ones than
    12 lines the first 12 stand. Joined on the name, so a body's words meet only the types of that name.
    """
    n = nodes.select("id", "name", "kind", "file", F.col("range_start").alias("start"), F.col("range_end").alias("end"))
    target = roots.select("root").distinct().join(n.withColumnRenamed("id", "root"), "root")
    body = target.join(files.select("file", "text"), "file").select("root", "file", F.col("start").alias("rs"), F.col("end").alias("re"), F.explode(words_of(slice_text(F.col("text"), F.col("start"), F.col("end")))).alias("name"))
    types = n.where(F.col("kind").isin(TYPE_KINDS) & (F.col("end") - F.col("start") + 1 <= MOST_REF_LINES)).where(~test_path(F.col("file")))
    types = types.select("id", "name", F.col("file").alias("there"), "start", "end")
    j = body.join(types, "name").where("id <> root and not (there = file and start <= re and end >= rs)")
    near = imported_files(nodes, edges, roots).select("root", F.col("file").alias("there"), F.lit(True).alias("imported"))
    j = j.join(near, ["root", "there"], "left").where("there = file or imported")
    w = Window.partitionBy("root").orderBy(F.col("there") != F.col("file"), "there", "id")
    j = j.select("root", "id", "file", "there", "start", "end").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    cut = F.least("end", F.col("start") + SHOWN_REF_LINES - 1)
    return j.select("root", "id", F.col("there").alias("file"), "start", cut.alias("end"), (F.col("end") > cut).alias("truncated"))


def declarations(files: DataFrame, most_lines: int = MOST_DECLARATION_LINES) -> DataFrame:
    """(file, name, start, end): each module-level declaration; of a name its first in the file.

    It ends where its brackets balance, else at a semicolon or where no = or comma carries on, after ``most_lines`` at most. Lines are numbered and the
    brackets after each line of a declaration summed by a window over its few lines.
    """
    lines = lines_of(files)
    head = r"^(?:export\s+)?(?:declare\s+)?(?:const|let|var|type|interface|enum|function|class)\s+([A-Za-z_$][\w$]*)"
    d = lines.select("file", F.col("line").alias("start"), F.regexp_extract("content", head, 1).alias("name")).where("name <> ''")
    d = d.groupBy("file", "name").agg(F.min("start").alias("start"))
    span = d.select("file", "name", "start", F.explode(F.sequence("start", F.col("start") + most_lines - 1)).alias("line")).join(lines, ["file", "line"])
    # Closing brackets below the first opened one don't count, as in a counter that stops at zero; only balance matters here.
    opens, closes = F.length(F.regexp_replace("content", r"[^{(\[]", "")), F.length(F.regexp_replace("content", r"[^})\]]", ""))
    w = Window.partitionBy("file", "name").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    s = span.withColumn("depth", F.sum(opens - closes).over(w)).withColumn("opened", F.sum(opens).over(w) > 0)
    tail = F.rtrim("content")
    ends = F.when(F.col("opened"), F.col("depth") <= 0).otherwise(tail.endswith(";") | ~tail.rlike("[=,]$"))
    return s.groupBy("file", "name", "start").agg(F.coalesce(F.min(F.when(ends, F.col("line"))), F.max("line")).alias("end"))


def imported_declarations(nodes: DataFrame, edges: DataFrame, files: DataFrame, roots: DataFrame, most: int = MOST_DECLARATIONS) -> DataFrame:
    """(root, name, file, start, end): declarations in imported files of names that a root's body uses and no node has.

    Names count in their order in the body, each from the first imported file that declares it; ``most`` a root.
    """
    n = nodes.select(F.col("id").alias("root"), "file", "range_start", "range_end")
    body = roots.select("root").distinct().join(n, "root").join(files.select("file", "text"), "file")
    words = body.select("root", F.posexplode(words_of(slice_text(F.col("text"), F.col("range_start"), F.col("range_end")))).alias("p", "name"))
    words = words.where((F.length("name") >= 2) & ~F.col("name").isin(KEYWORDS)).join(nodes.select("name").distinct(), "name", "left_anti")
    j = words.join(imported_files(nodes, edges, roots), "root").join(declarations(files), ["file", "name"])
    j = j.groupBy("root", "name").agg(F.min("p").alias("p"), F.min(F.struct("file", "start", "end")).alias("d"))
    w = Window.partitionBy("root").orderBy("p")
    j = j.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return j.select("root", "name", "d.file", "d.start", "d.end")


def module_frame(files: DataFrame, nodes: DataFrame, anchors: DataFrame, most_lines: int = 120) -> DataFrame:
    """(file, start, end): maximal runs of lines outside all entities and the comments and decorators above them, blank runs left out.

    Runs beyond ``most_lines`` of a file go, those farthest from its ``anchors`` (file, start, end) first, without anchors the last ones.
    """
    lines = lines_of(files)
    e = nodes.where("kind <> 'module'").select("file", F.col("range_start").alias("s"), F.col("range_end").alias("e"))
    e = e.join(files.select("file").distinct(), "file", "left_semi").distinct()
    inside = e.select("file", F.explode(F.sequence(F.greatest("s", F.lit(1).cast("long")), F.greatest("e", "s"))).alias("line")).distinct().withColumn("in", F.lit(True))
    l = lines.withColumn("line", F.col("line").cast("long")).join(inside, ["file", "line"], "left")
    plain = F.col("in").isNull() & F.col("content").rlike(DECORATION)
    # A decoration belongs to an entity if only decorations stand between it and the entity's first line.
    below = Window.partitionBy("file").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    starts = e.select("file", F.col("s").alias("line")).distinct().withColumn("starts", F.lit(True))
    l = l.join(starts, ["file", "line"], "left")
    stop = F.first(F.when(~plain, F.struct(F.coalesce("starts", F.lit(False)).alias("starts"))), ignorenulls=True).over(below)
    l = l.withColumn("above", plain & F.coalesce(stop["starts"], F.lit(False)))
    free = l.where("`in` is null and not above")
    run = free.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    runs = run.groupBy("file", "island").agg(F.min("line").alias("start"), F.max("line").alias("end"), F.max((F.trim("content") != "").cast("int")).alias("text")).where("text = 1")
    a = anchors.groupBy("file").agg(F.collect_list(F.struct("start", "end")).alias("a"))
    r = runs.join(a, "file", "left")
    gap = lambda x: F.when(F.col("end") < x["start"], x["start"] - F.col("end")).when(F.col("start") > x["end"], F.col("start") - x["end"]).otherwise(0).cast("long")
    far = F.when(F.col("a").isNull(), F.col("start")).otherwise(F.array_min(F.transform("a", gap)))
    w = Window.partitionBy("file").orderBy(far.desc(), "start")
    size = F.col("end") - F.col("start") + 1
    total = F.sum(size).over(Window.partitionBy("file"))
    dropped = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return r.withColumn("left", total - dropped).where(F.col("left") <= most_lines).select("file", "start", "end")


def change_slices(regions: DataFrame, nodes: DataFrame, files: DataFrame, most_lines: int = 120) -> DataFrame:
    """(file, role, id, start, end, text): what a change of regions (file, start, end) needs.

    A region's smallest containing entity, else all that it overlaps; the module's frame if a region has lines outside all entities; then
    the changed lines that are still uncovered. A pack that is not smaller than its file is that file, whole.
    """
    from .pack import enclosing_entities

    e = nodes.where("kind <> 'module'")
    regions = regions.select("file", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end")).distinct()
    roots = enclosing_entities(regions, e)
    held = roots.where("how = 'contains'").select("file", "start", "end")
    loose = regions.join(held, ["file", "start", "end"], "left_anti")
    inside = e.select("file", F.explode(F.sequence("range_start", F.greatest("range_end", "range_start"))).alias("line")).distinct()
    asked = loose.select("file", "start", "end", F.explode(F.sequence("start", "end")).alias("line"))
    touched = asked.join(inside, ["file", "line"], "left_anti").select("file").distinct()
    n = e.select("id", F.col("range_start").alias("s"), F.col("range_end").alias("e"))
    targets = roots.select("file", "id").distinct().join(n, "id").select("file", F.lit("target").alias("role"), "id", F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("end"))
    frame = module_frame(files.join(touched, "file", "left_semi"), nodes, regions, most_lines)
    slices = targets.union(frame.select("file", F.lit("frame"), F.lit(None).cast("string"), "start", "end"))
    length = files.select("file", F.size(F.split("text", "\n")).cast("long").alias("n"))
    changed = regions.join(length, "file").where("start <= n").select("file", F.explode(F.sequence(F.greatest("start", F.lit(1).cast("long")), F.least("end", "n"))).alias("line")).distinct()
    covered = slices.select("file", F.explode(F.sequence("start", "end")).alias("line")).distinct()
    rest = changed.join(covered, ["file", "line"], "left_anti")
    rest = rest.withColumn("island", F.col("line") - F.row_number().over(Window.partitionBy("file").orderBy("line")))
    rest = rest.groupBy("file", "island").agg(F.min("line").alias("start"), F.max("line").alias("end"))
    slices = slices.union(rest.select("file", F.lit("residual"), F.lit(None).cast("string"), "start", "end"))
    s = slices.join(files.select("file", "text"), "file").withColumn("whole", F.col("text")).withColumn("text", slice_text(F.col("whole"), F.col("start"), F.col("end")))
    cost = s.groupBy("file").agg(F.sum(tokens_of(F.length("text"))).alias("cost"), F.max(tokens_of(F.length("whole"))).alias("full"))
    s = s.drop("whole").join(cost, "file")
    small = s.where("cost < full").select("file", "role", "id", "start", "end", "text")
    large = cost.where("cost >= full").join(files.select("file", "text"), "file").join(length, "file")
    return small.union(large.select("file", F.lit("file"), F.lit(None).cast("string"), F.lit(1).cast("long"), "n", "text"))


def render_blocks(slices: DataFrame, group: str) -> DataFrame:
    """(group, pack, content_key, tokens, order): slices of a group in canonical order, each one a span, as headed blocks."""
    first = Window.partitionBy(group, "file", "start", "end").orderBy("role", "text")
    s = slices.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    head = F.concat(F.lit("### "), "file", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(" ("), "role", F.lit(")"))
    block = F.concat(head, F.lit("\n```\n"), "text", F.lit("\n```"))
    parts = F.sort_array(F.collect_list(F.struct("file", "start", "end", block.alias("block"))))
    g = s.groupBy(group).agg(parts.alias("p")).withColumn("pack", F.array_join(F.transform("p", lambda x: x["block"]), "\n\n"))
    return g.select(group, "pack", F.sha2("pack", 256).alias("content_key"), tokens_of(F.length("pack")).alias("tokens"), F.transform("p", lambda x: F.concat_ws(":", x["file"], x["start"].cast("string"), x["end"].cast("string"))).alias("order"))


def extended(slices: DataFrame, prior: DataFrame, group: str) -> DataFrame:
    """(group, position, key, part): the new set appended to a prior render, which stays as it is up to its first lost or changed slice.

    ``slices`` has group, file, start, end, text; ``prior`` group, position, key and digest of an earlier render.
    """
    from .pack import stable_prefix

    key = F.concat_ws(":", "file", F.col("start").cast("string"), F.col("end").cast("string"))
    now = slices.select(group, key.alias("key"), F.unhex(F.sha2("text", 256)).alias("d")).groupBy(group, "key").agg(F.min("d").alias("d"))
    # Digests are dealt out as 32 bytes; what isn't one equals none.
    old = F.when(F.col("digest").rlike("^[0-9a-f]{64}$"), F.unhex("digest")).otherwise(F.lit(b""))
    return stable_prefix(prior.withColumn("digest", old), now.withColumnRenamed("d", "digest"), group)


#: Rungs of a symbol's context, the cheapest first.
RUNGS = ["pack", "pack-2hop", "whole-file"]


def agent_context(rungs: DataFrame, slices: DataFrame, budget: int | None = None, level: str | None = None, version: str = "unknown") -> tuple[DataFrame, DataFrame]:
    """(choices, block) for each task: of every symbol one rung, all their slices as one block.

    ``rungs`` has task, symbol, rung (0 to 2), tokens (as rendered) and recommended; ``slices`` task, symbol, rung, file, start, end, role, text. A ``level`` takes
    the richest rung up to it; a ``budget`` the richest that fits it, else the cheapest, over budget; else the recommended one counts.
    The block's key names its symbols and everything that chose them.
    """
    if level is not None:
        pool = rungs.withColumn("ok", F.col("rung") <= RUNGS.index(level))
    elif budget is not None:
        pool = rungs.withColumn("ok", F.col("tokens") <= budget)
    else:
        pool = rungs.withColumn("ok", F.col("recommended"))
    w = Window.partitionBy("task", "symbol").orderBy(~F.col("ok"), F.when(F.col("ok"), -F.col("rung")).otherwise(F.col("rung")))
    c = pool.withColumn("n", F.row_number().over(w)).where("n = 1")
    over = ~F.col("ok") if budget is not None and level is None else F.lit(False)
    choices = c.select("task", "symbol", "rung", "tokens", over.alias("over_budget"))
    tag = F.lit(f"{version}|budget={budget}|level={level}")
    keys = choices.groupBy("task").agg(F.sha2(F.concat(F.to_json(F.sort_array(F.collect_set("symbol"))), F.lit("@"), tag), 256).alias("prefix_key"))
    block = render_blocks(slices.join(choices.select("task", "symbol", "rung"), ["task", "symbol", "rung"], "left_semi"), "task")
    return choices, block.join(keys, "task")


#: A pasted file in a prompt: path and body.
MARKER = r"""<file\s+path=(?:"([^"]+)"|'([^']+)')[^>]*>([\s\S]*?)</file>"""


def strip_markers(text: Column) -> Column:
    return F.regexp_replace(text, MARKER, " ")


def prompt_markers(prompts: DataFrame) -> DataFrame:
    """(prompt, n, path, body) of every pasted file of (prompt, text), in order."""
    groups = [F.regexp_extract_all("text", F.lit(MARKER), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(*[g.alias(x) for g, x in zip(groups, ("a", "b", "body"), strict=True)])
    m = prompts.select("prompt", F.posexplode(zipped).alias("n", "m"))
    return m.select("prompt", "n", F.when(F.col("m.a") != "", F.col("m.a")).otherwise(F.col("m.b")).alias("path"), F.col("m.body").alias("body"))


def marker_actions(markers: DataFrame, files: DataFrame, nodes: DataFrame, packs: DataFrame) -> DataFrame:
    """(prompt, n, path, action, tokens_before, tokens_after) of each pasted file.

    packed where the smaller pack (prompt, path, pack; from the symbols that the prompt's intent names in that file) replaces it; else why it stays: unreadable
    (no such file), not-whole-file (the body doesn't hold the file's text, or that is below 40 characters), not-indexed, no-intent, not-smaller.
    """
    trimmed = F.regexp_replace("text", r"^\s+|\s+$", "")
    f = files.select(F.col("file").alias("path"), trimmed.alias("disk"))
    indexed = nodes.where("kind <> 'module'").select(F.col("file").alias("path")).distinct().withColumn("indexed", F.lit(True))
    j = markers.join(f, "path", "left").join(indexed, "path", "left").join(packs.select("prompt", "path", "pack"), ["prompt", "path"], "left")
    before, after = tokens_of(F.length("body")), tokens_of(F.length("pack"))
    action = (
        F.when(F.col("disk").isNull(), "unreadable")
        .when((F.length("disk") < 40) | ~F.col("body").contains(F.col("disk")), "not-whole-file")
        .when(F.col("indexed").isNull(), "not-indexed")
        .when(F.col("pack").isNull(), "no-intent")
        .when(after >= before, "not-smaller")
        .otherwise("packed")
    )
    j = j.withColumn("action", action)
    return j.select("prompt", "n", "path", "action", before.alias("tokens_before"), F.when(F.col("action") == "packed", after).otherwise(before).alias("tokens_after"), "pack")


def rewrite_prompts(prompts: DataFrame, actions: DataFrame) -> DataFrame:
    """(prompt, text): the packed markers replaced in their places, the rest of each text byte for byte as it was."""
    packed = actions.groupBy("prompt").agg(F.sort_array(F.collect_list(F.struct("n", F.when(F.col("action") == "packed", F.concat(F.lit('<file path="'), "path", F.lit('">\n'), "pack", F.lit("\n</file>"))).alias("new")))).alias("m"))
    cut = "\x01"
    whole = F.regexp_extract_all("text", F.lit(MARKER), F.lit(0))
    between = F.split(F.regexp_replace("text", MARKER, cut), cut)
    j = prompts.join(packed, "prompt", "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<n:int,new:string>>")))
    fill = F.transform(whole, lambda w, i: F.coalesce(F.try_element_at(F.col("m"), i + 1)["new"], w))
    pieces = F.zip_with(between, fill, lambda t, w: F.concat(t, F.coalesce(w, F.lit(""))))
    return j.select("prompt", F.array_join(pieces, "").alias("text"))


def rewrite_stats(actions: DataFrame) -> DataFrame:
    """Per prompt: pasted files, those packed, tokens before, after and saved."""
    a = actions.groupBy("prompt").agg(F.count("*").alias("files"), F.count(F.when(F.col("action") == "packed", 1)).alias("packed"), F.sum("tokens_before").alias("tokens_before"), F.sum("tokens_after").alias("tokens_after"))
    return a.withColumn("saved", F.col("tokens_before") - F.col("tokens_after"))


def fleet_split(slices: DataFrame, exemplars: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(slices with part, totals): part is shared for spans that ``least`` lanes need or an exemplar (key) pins, else unique to the lane.

    ``slices`` has lane, key, tokens. Shared spans are sent once; totals compare with sending every lane all of its own.
    """
    s = slices.groupBy("lane", "key").agg(F.max("tokens").alias("tokens"))
    lanes = s.groupBy("key").agg(F.count("*").alias("lanes"))
    pinned = exemplars.select("key").distinct().withColumn("pinned", F.lit(True))
    s = s.join(lanes, "key").join(pinned, "key", "left")
    shared = (F.col("lanes") >= max(2, least)) | F.col("pinned").isNotNull()
    s = s.select("lane", "key", "tokens", F.when(shared, "shared").otherwise("unique").alias("part"))
    once = s.where("part = 'shared'").groupBy("key").agg(F.max("tokens").alias("tokens")).agg(F.count("*").alias("shared_slices"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("shared_tokens"))
    naive = s.agg(F.countDistinct("lane").alias("lanes"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("naive"), F.coalesce(F.sum(F.when(F.col("part") == "unique", F.col("tokens"))), F.lit(0)).alias("unique_tokens"))
    totals = naive.crossJoin(once)  # one row each
    return s, totals.select("lanes", "shared_slices", "naive", (F.col("shared_tokens") + F.col("unique_tokens")).alias("deduped"), (F.col("naive") - F.col("shared_tokens") - F.col("unique_tokens")).alias("saved"))


def compact_reads(messages: DataFrame, slices: DataFrame, edited: DataFrame, keep: int = 8) -> DataFrame:
    """(conv_id, turn, path, kind, tokens_before, tokens_after): old reads of files become the slice that matters, or a pointer, where that is shorter.

    ``messages`` has conv_id, turn, path (of a read, else null), text; ``slices`` conv_id, path, text (by intent), ``edited`` conv_id, path, text (the
    edited file's own symbols, which an aged read keeps). The last ``keep`` messages stay.
    """
    w = Window.partitionBy("conv_id")
    age = F.count("*").over(w) - F.row_number().over(w.orderBy("turn"))
    m = messages.withColumn("age", age).where((F.col("age") >= keep) & F.col("path").isNotNull() & (F.length("text") > 0))
    more = slices.select("conv_id", "path", F.col("text").alias("by_intent")).join(edited.select("conv_id", "path", F.col("text").alias("by_edit")), ["conv_id", "path"], "full_outer")
    j = m.join(more, ["conv_id", "path"], "left")
    lines = F.size(F.split("text", "\n"))
    body = F.concat_ws("\n\n", "by_intent", "by_edit")
    named = F.concat(F.lit("[older read of "), "path", F.lit(" compacted (was ~"), lines.cast("string"), F.lit(" lines)]\n\n"), body)
    pointer = F.concat(F.lit("[older read of "), "path", F.lit(" (~"), lines.cast("string"), F.lit(" lines) left out; read the file again if needed]"))
    kind = F.when((body != "") & (F.length(named) < F.length("text")), "slice").when(F.length(pointer) < F.length("text"), "pointer")
    j = j.withColumn("kind", kind).where("kind is not null")
    after = F.when(F.col("kind") == "slice", F.length(named)).otherwise(F.length(pointer))
    return j.select("conv_id", "turn", "path", "kind", tokens_of(F.length("text")).alias("tokens_before"), tokens_of(after).alias("tokens_after"))


def compaction_stats(reads: DataFrame) -> DataFrame:
    return reads.agg(F.count("*").alias("compacted"), F.coalesce(F.sum("tokens_before"), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("tokens_after"), F.lit(0)).alias("tokens_after"))


#: Nodes of one drawn graph at most; larger ones are drawn as clusters.
MOST_DRAWN = 2000


def force_layout(nodes: DataFrame, edges: DataFrame, steps: int = 1, width: float = 800.0, height: float = 600.0, repulsion: float = 400.0, spring: float = 0.05, length: float = 60.0, gravity: float = 0.005, damping: float = 0.85, dt: float = 1.0) -> DataFrame:
    """(graph, id, x, y, vx, vy, energy) after ``steps`` of a force layout of each graph (graph, id, x, y, vx, vy, mass).

    Repulsion by mass over distance, springs along edges (graph, src, dst, weight), gravity to the centre, damping. A graph is drawn whole by one task, so it is bounded: more
    than 2000 nodes are an error, they are to be clustered first. All pairs are exact; the energy is the graph's kinetic one.
    """
    links = edges.groupBy("graph", F.col("src").alias("id")).agg(F.collect_list(F.struct("dst", F.col("weight").cast("double").alias("w"))).alias("links"))

    def draw(f: pd.DataFrame) -> pd.DataFrame:
        if len(f) > MOST_DRAWN:
            raise ValueError(f"{len(f)} nodes in one drawing; cluster them first")
        f = f.sort_values("id").reset_index(drop=True)
        p, v, m = f[["x", "y"]].to_numpy(float), f[["vx", "vy"]].to_numpy(float), f["mass"].to_numpy(float)
        at = {k: i for i, k in enumerate(f["id"])}
        ends = [(i, at[l["dst"]], l["w"]) for i, ls in enumerate(f["links"]) if ls is not None for l in ls if l["dst"] in at]
        a, b, w = (np.array([e[k] for e in ends]) for k in range(3)) if ends else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for _ in range(steps):
            d = p[None, :, :] - p[:, None, :]
            d2 = np.maximum((d**2).sum(axis=2), 0.01)
            push = -repulsion * m[None, :] / (d2 * np.sqrt(d2))
            np.fill_diagonal(push, 0)
            v = v + (d * push[:, :, None]).sum(axis=1)
            if len(a):
                e = p[b] - p[a]
                r = np.sqrt((e**2).sum(axis=1))
                r[r == 0] = 0.01
                force = (spring * (r - length) * np.minimum(2, 0.5 + np.log10(1 + w)) / r)[:, None] * e
                np.add.at(v, a, force / m[a][:, None])
                np.add.at(v, b, -force / m[b][:, None])
            v = (v + (np.array([width / 2, height / 2]) - p) * gravity) * damping
            p = p + v * dt
        energy = float((m * (v**2).sum(axis=1)).sum())
        return pd.DataFrame({"graph": f["graph"], "id": f["id"], "x": p[:, 0], "y": p[:, 1], "vx": v[:, 0], "vy": v[:, 1], "energy": energy})

    joined = nodes.join(links, ["graph", "id"], "left")
    kind = {c: nodes.schema[c].dataType.simpleString() for c in ("graph", "id")}
    return joined.groupBy("graph").applyInPandas(draw, f"graph {kind['graph']}, id {kind['id']}, x double, y double, vx double, vy double, energy double")


def start_positions(nodes: DataFrame, edges: DataFrame, width: float = 800.0, height: float = 600.0, seed: str = "layout") -> DataFrame:
    """Nodes (graph, id) scattered on a ring by hashes, at rest, with masses from their degrees."""
    both = edges.select("graph", F.col("src").alias("id")).union(edges.select("graph", "dst"))
    degree = both.groupBy("graph", "id").agg(F.count("*").alias("degree"))
    unit = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed + salt), F.col("id"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    angle, far = unit("a") * 6.283185307179586, F.lit(min(width, height) * 0.35) * (0.4 + 0.6 * unit("r"))
    n = nodes.select("graph", "id").distinct().join(degree, ["graph", "id"], "left")
    return n.select("graph", "id", (width / 2 + F.cos(angle) * far).alias("x"), (height / 2 + F.sin(angle) * far).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (1 + F.coalesce("degree", F.lit(0)) * 0.25).alias("mass"))
