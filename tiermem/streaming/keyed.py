"""Keyed streaming state: idempotent turn ingest, message settling, usage reports.

State lives in the RocksDB store of the query, one entry per key that was seen, so a
long session does not have to fit in a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType


def _struct(**fields: object) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


TURN_VERDICTS = (
    "store_key string, session_id string, arrival long, id string, turn_index long, turn_id string, "
    "content string, verdict string, kept_id string"
)


class _TurnKeys(StatefulProcessor):
    """Turn indexes and turn ids one session has used."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.by_index = handle.getMapState(
            "by_index", _struct(turn_index=LongType()), _struct(id=StringType(), digest=StringType())
        )
        self.by_id = handle.getMapState(
            "by_id", _struct(turn_id=StringType()), _struct(id=StringType(), turn_index=LongType())
        )

    def _judge(self, row) -> tuple[str, str | None]:
        index = None if pd.isna(row.turn_index) else int(row.turn_index)
        turn = None if pd.isna(row.turn_id) else row.turn_id
        if index is not None and self.by_index.containsKey((index,)):
            owner, digest = self.by_index.getValue((index,))
            return ("duplicate", owner) if digest == row.digest else ("index_conflict", None)
        if turn is not None and self.by_id.containsKey((turn,)):
            owner, at = self.by_id.getValue((turn,))
            return ("duplicate", owner) if at == index else ("turn_id_conflict", None)
        if index is not None:
            self.by_index.updateValue((index,), (row.id, row.digest))
        if turn is not None:
            self.by_id.updateValue((turn,), (row.id, index))
        return "accepted", None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("arrival")
        verdicts = [self._judge(row) for row in batch.itertuples()]
        out = batch.assign(verdict=[v for v, _ in verdicts], kept_id=[k for _, k in verdicts])
        yield out[["store_key", "session_id", "arrival", "id", "turn_index", "turn_id", "content", "verdict", "kept_id"]]

    def close(self) -> None:
        pass


def ingest_turn_stream(turns: DataFrame) -> DataFrame:
    """Streaming twin of ``ingest_turns``: every arriving turn with its verdict."""
    rows = turns.select(
        "store_key", "session_id", F.col("arrival").cast("long").alias("arrival"), "id",
        F.col("turn_index").cast("long").alias("turn_index"), "turn_id", "content",
        F.sha2("content", 256).alias("digest"),
    )
    return rows.groupBy("store_key", "session_id").transformWithStateInPandas(
        statefulProcessor=_TurnKeys(), outputStructType=TURN_VERDICTS, outputMode="Append", timeMode="None"
    )


class _Pending(StatefulProcessor):
    """Latest text, settle role and delivery mark of one message."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState(
            "message", _struct(session_id=StringType(), text=StringType(), role=StringType(), sent=LongType())
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, text, role, sent = self.state.get() if self.state.exists() else (None, None, None, 0)
        out = []
        for row in pd.concat(list(rows)).sort_values("event_seq").itertuples():
            if sent:
                break
            session = row.session_id
            if row.kind == "part":
                text = row.text
            else:
                role = row.role
            if role is not None and text is not None and text.strip():
                out.append((key[0], session, role, text.strip()))
                text, sent = None, 1
        self.state.update((session, text, role, sent))
        if out:
            yield pd.DataFrame(out, columns=["message_id", "session_id", "role", "content"])

    def close(self) -> None:
        pass


def settle_message_stream(events: DataFrame) -> DataFrame:
    """events(message_id, session_id, event_seq, kind, role, text) -> each message once.

    A part replaces the text before it. The message goes out when it has settled and
    has text, whichever comes last; blank text never goes out.
    """
    return events.groupBy("message_id").transformWithStateInPandas(
        statefulProcessor=_Pending(), outputStructType="message_id string, session_id string, role string, content string",
        outputMode="Append", timeMode="None",
    )


def settle_messages(events: DataFrame) -> DataFrame:
    """Batch twin of ``settle_message_stream``."""
    order = Window.partitionBy("message_id").orderBy("event_seq").rowsBetween(Window.unboundedPreceding, 0)
    is_part = F.col("kind") == "part"
    seen = events.withColumns({
        "_text": F.last(F.when(is_part, F.coalesce("text", F.lit(""))), ignorenulls=True).over(order),
        "_role": F.last(F.when(~is_part, F.col("role")), ignorenulls=True).over(order),
    })
    trimmed = F.regexp_replace("_text", r"^\s+|\s+$", "")
    ready = seen.where(F.col("_role").isNotNull() & (trimmed != "")).withColumn("content", trimmed)
    return ready.groupBy("message_id").agg(
        F.min(F.struct("event_seq", "session_id", F.col("_role").alias("role"), "content")).alias("m")
    ).select("message_id", "m.session_id", "m.role", "m.content")


USAGE_OUT = "recall_id string, report_id string, tier string, item_id string, target string, outcome string"


class _Usage(StatefulProcessor):
    """Usage state of the items of one recall."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState(
            "items", _struct(tier=StringType(), item_id=StringType()), _struct(usage=StringType())
        )

    def _report(self, refs: pd.DataFrame) -> list[str]:
        keys = list(zip(refs["tier"], refs["item_id"]))
        if any(not self.items.containsKey(k) for k in keys):
            return ["unknown_items"] * len(keys)
        targets: dict[tuple, set] = {}
        for k, target in zip(keys, refs["target"]):
            targets.setdefault(k, set()).add(target)
        now = {k: self.items.getValue(k)[0] for k in targets}
        flips = any(now[k] in ("used", "unused") and t != {now[k]} for k, t in targets.items())
        if flips or any(len(t) > 1 for t in targets.values()):
            return ["conflict"] * len(keys)
        for k, target in zip(keys, refs["target"]):
            self.items.updateValue(k, (target,))
        return ["unchanged" if now[k] == target else "updated" for k, target in zip(keys, refs["target"])]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["event_seq", "report_id"])
        fresh = batch[batch["report_id"].isna()]
        for row in fresh.itertuples():
            if not self.items.containsKey((row.tier, row.item_id)):
                self.items.updateValue((row.tier, row.item_id), (row.target,))
        for _, refs in batch[batch["report_id"].notna()].groupby(["event_seq", "report_id"], sort=True):
            out = refs[["report_id", "tier", "item_id", "target"]].assign(outcome=self._report(refs))
            yield out.assign(recall_id=key[0])[["recall_id", "report_id", "tier", "item_id", "target", "outcome"]]

    def close(self) -> None:
        pass


def usage_report_stream(events: DataFrame) -> DataFrame:
    """events(recall_id, event_seq, report_id, tier, item_id, target): a row without a
    report id opens an item with its usage state; the others are the rows of reports."""
    return events.groupBy("recall_id").transformWithStateInPandas(
        statefulProcessor=_Usage(), outputStructType=USAGE_OUT, outputMode="Append", timeMode="None"
    )
