"""Content-derived ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _digest(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def atom_id(type_: Column, content: Column) -> Column:
    return F.concat(F.lit("l1-"), _digest(F.concat(type_, F.lit(":"), content), 24))


def episode_id(session_id: Column) -> Column:
    return F.concat(F.lit("episode:"), _digest(session_id, 24))


def topic_id(store_key: Column, leader: Column, pass_id: Column) -> Column:
    """Replayable topic id: the same pass over the same leader gives the same id."""
    return F.concat(F.lit("topic:"), _digest(F.concat_ws("|", store_key, leader, pass_id), 24))


def pass_id(store_key: Column, start: Column, end: Column) -> Column:
    """``start`` may be null (never processed); a null ``end`` is the empty pass."""
    text = F.concat_ws(
        "|",
        store_key,
        F.coalesce(start.cast("string"), F.lit("")),
        F.coalesce(end.cast("string"), F.lit("empty")),
    )
    return F.concat(F.lit("pass-"), _digest(text, 16))


def decision_id(pass_: Column, position: Column) -> Column:
    return F.concat(pass_, F.lit("-dec-"), position.cast("string"))


def render_hash(title: Column, summary: Column) -> Column:
    return F.sha2(F.concat(title, F.lit("\n"), F.coalesce(summary, F.lit(""))), 256)
