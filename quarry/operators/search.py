"""Ranked text search over named rows, many queries in one job.

A query is a list of OR-groups that must all match (precise) or of which any may (relaxed). Terms
match as substrings without case and need three letters, as in a trigram index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..durable import materialize
from ..functions.names import STOP_WORDS, expand_terms, sanitize_terms, scaffold_path


def search_path(file: Column, id_: Column) -> Column:
    return F.translate(F.concat_ws(" ", F.coalesce(file, F.lit("")), id_), "/.-_", "    ")


def _any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        if len(t) >= 3:
            out = out | text.contains(t.lower())
    return out


def query_groups(query: str, relaxed: bool = False) -> list[list[str]]:
    groups = expand_terms(sanitize_terms(query))
    if relaxed:
        content = [g for g in groups if g[0].lower() not in STOP_WORDS]
        return content or groups
    return groups


def matches(text: Column, groups: list[list[str]], relaxed: bool = False) -> Column:
    if not groups:
        return F.lit(False)
    text = F.lower(text)
    hits = [_any(text, g) for g in groups]
    out = hits[0]
    for h in hits[1:]:
        out = (out | h) if relaxed else (out & h)
    return out


def search(rows: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows that match precisely; if none does, those that match relaxed."""
    hit = rows.where(matches(text, query_groups(query)))
    return hit if not hit.isEmpty() else rows.where(matches(text, query_groups(query, True), True))


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, length): word postings of a text column."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    d = docs.select(key, words.alias("w")).withColumn("length", F.size("w"))
    return d.select(key, "length", F.explode("w").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def _occurrences(term: str) -> Column:
    return F.size(F.filter("w", lambda w: w == term))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score), lower is better: the negated BM25 of lower-cased whole words of three letters or more.

    Only postings of the asked terms are shuffled; lengths are averaged in the same pass.
    """
    asked = [t.lower() for t in terms]
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    d = docs.select(key, words.alias("w")).select(key, F.size("w").alias("length"), *[_occurrences(t).alias(f"t{i}") for i, t in enumerate(asked)])
    facts = d.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count(F.when(F.col(f"t{i}") > 0, 1)).alias(f"d{i}") for i in range(len(asked))])
    d = d.where(" or ".join(f"t{i} > 0" for i in range(len(asked)))).crossJoin(F.broadcast(facts))  # one row
    score = F.lit(0.0)
    for i in range(len(asked)):
        tf, df = F.col(f"t{i}"), F.col(f"d{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score - idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return d.select(key, F.round(score, 6).alias("score"))


def rerank(hits: DataFrame, edges: DataFrame, scaffold: Column, limit: int) -> DataFrame:
    """The best ``limit`` of (id, score) after degree and scaffolding: only a pool of max(50, 4 limit) is joined.

    final = score - 0.30 ln(1 + degree) + 1.0 for scaffold files.
    """
    pool = materialize(hits.orderBy("score", "id").limit(max(50, 4 * limit)))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).join(F.broadcast(pool.select("id")), "id", "left_semi")  # bounded by the pool
    d = ends.groupBy("id").agg(F.count("*").alias("degree"))
    final = F.round(F.col("score") - 0.30 * F.ln(1 + F.coalesce("degree", F.lit(0))) + F.when(scaffold, 1.0).otherwise(0.0), 6)
    out = pool.join(d, "id", "left").withColumn("final", final)
    return out.orderBy("final", "score", "id").limit(limit).select("id", "score", F.coalesce("degree", F.lit(0)).alias("degree"), "final")


def under_path(file: Column, prefix: str) -> Column:
    """Case-sensitive prefix; blanks trimmed, one trailing slash dropped."""
    p = prefix.strip()
    p = p[:-1] if p.endswith("/") else p
    return file.startswith(p) if p else F.lit(True)


def live(created: Column, ttl: Column, now_ms: int) -> Column:
    return ttl.isNull() | (created + ttl * 1000 >= now_ms)


#: The weight of each searched column.
FIELD_WEIGHTS = {"name": 1.0, "qualified_name": 1.0, "summary": 1.0, "path": 0.35}


def _phrases(text: str, term: str) -> Column:
    """How often a term stands in a column, overlaps included, without case; terms below three letters never do."""
    return F.regexp_count(text, F.lit(f"(?=\\Q{term.lower()}\\E)")) if len(term) >= 3 else F.lit(0)


def field_scores(rows: DataFrame, key: str, weights: dict[str, float], terms: list[str], hit: Column, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that ``hit``, lower is better: BM25 over trigram columns, each with its weight.

    A row's length is its trigrams. Rows, lengths and rows that hold a term are counted over all rows in the same pass.
    """
    texts = rows.select(key, *[F.lower(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in weights])
    length = sum((F.greatest(F.length(c) - 2, F.lit(0)) for c in weights), F.lit(0))
    d = texts.select(key, length.alias("__l"), hit.alias("__hit"), *[F.struct(*[_phrases(c, t).alias(c) for c in weights]).alias(f"t{i}") for i, t in enumerate(terms)])
    any_of = lambda i: sum((F.col(f"t{i}.{c}") for c in weights), F.lit(0)) > 0
    facts = d.agg(F.count("*").alias("n"), F.avg("__l").alias("mean"), *[F.count(F.when(any_of(i), 1)).alias(f"d{i}") for i in range(len(terms))])
    d = d.where("__hit").crossJoin(F.broadcast(facts))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = sum((F.col(f"t{i}.{c}") * w for c, w in weights.items()), F.lit(0.0))
        idf = F.ln((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        score = score - idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__l") / F.col("mean")))
    return d.select(key, F.round(score, 6).alias("score"))


def ranked_search(nodes: DataFrame, edges: DataFrame, query: str, limit: int = 20, path: str | None = None, semantic: list[str] | None = None) -> DataFrame:
    """The best nodes (id, score, degree, final) for a query: precise, and relaxed if nothing matches precisely.

    ``nodes`` has id, name, qualified_name, summary, file. ``semantic`` terms (a model's, at most eight) add matches and never take any away.
    """
    n = nodes.withColumn("path", search_path(F.col("file"), F.col("id")))
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in FIELD_WEIGHTS])
    more = [t for t in (semantic or [])[:8] if len(t) >= 3]

    def attempt(relaxed: bool) -> DataFrame:
        groups = query_groups(query, relaxed)
        hit = matches(text, groups, relaxed)
        for t in more:
            hit = hit | F.lower(text).contains(t.lower())
        scores = field_scores(n, "id", FIELD_WEIGHTS, [t for g in groups for t in g] + more, hit)
        found = scores.join(n.select("id", "file"), "id")
        return materialize(found if path is None else found.where(under_path(F.col("file"), path)))

    hits = attempt(False)
    if hits.isEmpty() and query_groups(query, True):
        hits = attempt(True)
    return rerank(hits, edges, scaffold_path(F.col("file")), limit)


def task_symbols(nodes: DataFrame, edges: DataFrame, task: str, cap: int = 3) -> DataFrame:
    """The first ``cap`` symbols for a task's text: the search's best, modules left out."""
    pool = ranked_search(nodes, edges, task, max(5 * cap, 20))
    return pool.join(nodes.select("id", "kind"), "id").where("kind <> 'module'").orderBy("final", "score", "id").limit(cap).select("id", "score", "final")


def resolve_node(nodes: DataFrame, edges: DataFrame, asked: str, fuzzy_paths: bool = False) -> DataFrame:
    """(asked, id, exact): the node of that id, else the search's best. An id with a slash is not guessed unless ``fuzzy_paths``."""
    exact = nodes.where(F.col("id") == asked).select(F.lit(asked).alias("asked"), "id", F.lit(True).alias("exact"))
    if ("/" in asked and not fuzzy_paths) or not exact.isEmpty():
        return exact
    return ranked_search(nodes, edges, asked, 1).select(F.lit(asked).alias("asked"), "id", F.lit(False).alias("exact"))


def search_notes(notes: DataFrame, query: str, now_ms: int, limit: int = 100) -> DataFrame:
    """Live notes that recall a query, newest first: precise, else relaxed; a query without terms is looked for as it stands."""
    n = notes.where(live(F.col("created"), F.col("ttl"), now_ms))
    hit = search(n, F.col("note"), query) if query_groups(query) else n.where(F.lower("note").contains(query.lower()))
    return hit.orderBy(F.col("created").desc(), "id").limit(max(0, limit))


def navigation_metrics(results: DataFrame) -> DataFrame:
    """(cohort, query, rank of the answer or null) to top1, top5, found and mean reciprocal rank per cohort."""
    n, r = F.count("*"), F.col("rank")
    return results.groupBy("cohort").agg(n.alias("n"), F.count(F.when(r == 1, 1)).alias("top1"), F.count(F.when(r <= 5, 1)).alias("top5"), F.count(r).alias("found"), F.round(F.avg(F.coalesce(1 / r, F.lit(0.0))), 6).alias("mrr"))


def rank_within(df: DataFrame, group: str, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
