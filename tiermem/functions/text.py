"""Text columns: tokens, cut-offs, rendered scene text and budgets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The token alphabet, the per-item caps and the recall budgets.
TOKEN = "[0-9a-zA-ZÀ-ɏЀ-ӿ一-鿿]++"
ATOM_CAP = 600
SCENE_CAP = 1800
LEGACY_CAP = 2000
SNIPPET_CHARS = 300
EXPLICIT_BUDGET = 6000
AUTO_BUDGET = 3500
MAX_BUDGET = 20000


def tokens(text: Column) -> Column:
    """Lower-cased tokens of a text: the longest runs of the alphabet.

    Extracting runs is several times faster than splitting at everything else.
    """
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def truncate(text: Column, cap: int | Column) -> Column:
    """The text, or its first ``cap - 3`` characters and three dots."""
    limit = F.lit(cap) if isinstance(cap, int) else cap
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(F.substring(text, F.lit(1), limit - 3), F.lit("..."))
    )


def snippet(text: Column, chars: int = SNIPPET_CHARS) -> Column:
    return F.when(F.length(text) <= chars, text).otherwise(
        F.concat(F.substring(text, 1, chars), F.lit("…"))
    )


def scene_text(kind: Column, title: Column, summary: Column) -> Column:
    head = F.concat(F.lit("["), kind, F.lit("] "), title)
    has_summary = summary.isNotNull() & (summary != "")
    return F.when(has_summary, F.concat(head, F.lit("\n"), summary)).otherwise(head)


def scene_embed_text(title: Column, summary: Column) -> Column:
    has_summary = summary.isNotNull() & (summary != "")
    return F.when(has_summary, F.concat(title, F.lit("\n"), summary)).otherwise(title)


def budget(requested: Column, mode: Column) -> Column:
    """Requested budget or the default of the mode, never above the ceiling."""
    default = F.when(mode == "auto", AUTO_BUDGET).otherwise(EXPLICIT_BUDGET)
    return F.least(F.coalesce(requested, default), F.lit(MAX_BUDGET))
