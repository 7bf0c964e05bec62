"""Replies of model oracles as verdicts: column expressions; the model itself is the caller's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def yes_no(reply: Column) -> Column:
    """True for a reply whose first word among yes and no is yes, false for no, null for neither."""
    word = F.lower(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?i)\b(yes|no)\b", 1))
    return F.when(word == "yes", True).when(word == "no", False)


def first_object(reply: Column) -> Column:
    """The first brace-delimited object of a reply (one nesting level), comments and trailing commas removed."""
    body = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})", 1)
    body = F.regexp_replace(body, r"(?m)^\s*//[^\n]*$", "")
    body = F.regexp_replace(body, r",(\s*[}\]])", "$1")
    return F.when(body != "", body)


def edit_facts(reply: Column) -> Column:
    """An extractor's reply as a struct: entity, signature_changed, references; null if it is no object."""
    return F.from_json(first_object(reply), "entity string, signature_changed boolean, references array<string>")


def extractor_conflict(a: Column, b: Column) -> Column:
    """Two extracted edits conflict on the same entity, or where one changes the signature of what the other refers to."""
    cross = (a["signature_changed"] & F.array_contains(b["references"], a["entity"])) | (b["signature_changed"] & F.array_contains(a["references"], b["entity"]))
    return F.coalesce((a["entity"] == b["entity"]) | F.coalesce(cross, F.lit(False)), F.lit(False))
