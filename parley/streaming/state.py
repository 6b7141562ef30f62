"""Streaming rules that keep a state by key: islands closed by event time, token pieces, context buffers, phases.

State is kept in RocksDB, so it need not fit in memory, and nothing is kept for ever: islands go when the watermark has
passed them, all other keys when they have been idle for a while.
"""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from parley.functions import lexicons as L

#: Milliseconds after which the state of an idle key is dropped.
IDLE = 24 * 3600 * 1000


def _store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextlib.contextmanager
def data_batches_only(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run no batch without new rows, so that a run over what is there now ends.

    A key's idle time is measured by the clock, and a query that looks for idle keys would start batches for ever.
    """
    conf = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        yield
    finally:
        spark.conf.set(conf, before)


def _millis(t: datetime.datetime) -> int:
    return int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) if t.tzinfo is None else int(t.timestamp() * 1000)


# Islands.


def _clash(a: list[str], b: list[str]) -> bool:
    return any((set(a) & set(x) and set(b) & set(y)) or (set(a) & set(y) and set(b) & set(x)) for x, y in L.TAG_CONFLICTS)


class _Islands(StatefulProcessor):
    """Rows of open islands of a conversation, and a timer at which the first of them may be closed."""

    def __init__(self, within: int, short: int, rapid: int, bursts: list[str]):
        self.within, self.short, self.rapid, self.bursts = within, short, rapid, bursts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, seq long, msg_uid string, speaker string, modality string, text_raw string, tags array<string>")

    def _joins(self, a: tuple, b: tuple) -> bool:
        gap = (b[0] - a[0]) / 1000
        if a[3] is None or a[3] != b[3] or a[4] != "text" or b[4] != "text" or gap > self.within or _clash(a[6], b[6]):
            return False
        one, two = a[5], b[5]
        small = one is not None and two is not None and len(one) <= self.short and len(two) <= self.short
        return not (self.bursts and small and gap <= self.rapid and any(w in one + two for w in self.bursts))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        new = [(_millis(r.ts), r.seq, r.msg_uid, r.speaker, r.modality, r.text_raw, list(r.emotion_tags or [])) for r in rows]
        self.open.appendList(new)
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(min(r[0] for r in new) + self.within * 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.open.get(), key=lambda r: (r[0], r[1]))
        islands: list[list[tuple]] = []
        for r in rows:
            if islands and self._joins(islands[-1][-1], r):
                islands[-1].append(r)
            else:
                islands.append([r])
        closed = 0
        while closed < len(islands) and islands[closed][-1][0] + self.within * 1000 < passed:
            closed += 1
        for m in islands[:closed]:
            texts = [r[5] for r in m if r[5]]
            text = (" " if all(len(t) < 10 for t in texts) else "\n").join(texts)
            yield Row(conv_id=key[0], ts=m[0][0] // 1000, seq=m[0][1], speaker=m[0][3], text_raw=text, merged_count=len(m), original_ids=[r[2] for r in m], end_ts=m[-1][0] // 1000, emotion_tags=sorted({t for r in m for t in r[6]}))
        left = [r for m in islands[closed:] for r in m]
        if left:
            self.open.put(left)
            self.handle.registerTimer(max(islands[closed][-1][0] + self.within * 1000, passed) + 1)
        else:
            self.open.clear()

    def close(self) -> None:
        pass


def islands(messages: DataFrame, within: int = 60, late: str = "10 minutes", short: int = 5, rapid: int = 10, bursts: list[str] = ()) -> DataFrame:
    """Merged messages as timeline.merge_messages gives them, from a stream of conv_id, seq, ts (timestamp), speaker,
    modality, text_raw, emotion_tags, msg_uid that may come out of order by `late`.

    An island is sent out once the watermark has passed its last row by `within` seconds, so no later row can join it.
    Rows behind the watermark are left out; `late_rows` counts them.
    """
    _store(messages.sparkSession)
    key = messages.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {key}, ts long, seq long, speaker string, text_raw string, merged_count int, original_ids array<string>, end_ts long, emotion_tags array<string>"
    return messages.withWatermark("ts", late).groupBy("conv_id").transformWithState(_Islands(within, short, rapid, list(bursts)), out, "append", "eventTime")


def late_rows(query: Any) -> int:
    """Rows of a running or ended query that came behind the watermark and were left out."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])


# Token pieces.


def _flush(buffer: str, threshold: int, ends: str) -> tuple[list[str], str]:
    pieces = []
    while buffer:
        stop = next((i + 1 for i, c in enumerate(buffer) if c in ends), None)
        if stop is None and len(buffer) < threshold:
            break
        stop = min(stop or threshold, threshold) if len(buffer) >= threshold else stop
        pieces.append(buffer[:stop])
        buffer = buffer[stop:]
    return pieces, buffer


class _Tokens(StatefulProcessor):
    def __init__(self, threshold: int, ends: str, banned: dict[str, str], idle: int):
        self.threshold, self.ends, self.banned, self.idle = threshold, ends, banned, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getValueState("buffer", "text string", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        buffer, out, done = self.buffer.get()[0] if self.buffer.exists() else "", [], False
        for r in sorted(rows, key=lambda r: r.seq):
            pieces, buffer = _flush(buffer + (r.token or ""), self.threshold, self.ends)
            out += pieces
            done = done or bool(r.is_last)
        if done:
            out += [buffer] if buffer else []
            self.buffer.clear()
        else:
            self.buffer.update((buffer,))
        for piece in out:
            for word, new in self.banned.items():
                piece = piece.replace(word, new)
            yield Row(session_id=key[0], piece=piece)

    def close(self) -> None:
        pass


def guarded_tokens(tokens: DataFrame, threshold: int = 16, ends: str = ".!?\n", banned: dict[str, str] | None = None, idle: int = IDLE) -> DataFrame:
    """(session_id, piece): tokens (session_id, seq, token, is_last) buffered per session until a sentence ends or the
    buffer reaches `threshold` characters; banned words are replaced in each piece; the rest follows with the last token.
    The buffer of a session that has been idle for `idle` milliseconds is dropped."""
    _store(tokens.sparkSession)
    return tokens.groupBy("session_id").transformWithState(_Tokens(threshold, ends, banned or {}, idle), "session_id long, piece string", "append", "processingTime")


# Context buffers.


class _Turns(StatefulProcessor):
    def __init__(self, keep: int, idle: int):
        self.keep, self.idle = keep, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "text string", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = [r[0] for r in self.held.get()]
        for r in sorted(rows, key=lambda r: r.turn):
            held = [*held, r.text or ""][-self.keep :]
            yield Row(conv_id=key[0], turn=r.turn, context="\n".join(held))
        self.held.put([(t,) for t in held])

    def close(self) -> None:
        pass


def last_turns(turns: DataFrame, keep: int, idle: int = IDLE) -> DataFrame:
    """(conv_id, turn, context): each turn with the last `keep` texts of its conversation, itself included.

    A conversation idle for `idle` milliseconds is forgotten and starts anew.
    """
    _store(turns.sparkSession)
    return turns.groupBy("conv_id").transformWithState(_Turns(keep, idle), "conv_id long, turn long, context string", "append", "processingTime")


# Phases.

INTERRUPT, RESUME, INTERRUPTED = "interrupt", "continue", "interrupted"


class _Phases(StatefulProcessor):
    def __init__(self, order: list[str], idle: int):
        self.order, self.place, self.idle = order, {p: i for i, p in enumerate(order)}, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "place int, held boolean", self.idle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        now, held = self.now.get() if self.now.exists() else (-1, False)
        for r in sorted(rows, key=lambda r: r.seq):
            to = self.place.get(r.phase, -1)
            if r.phase == INTERRUPT and not held:
                held = True
                yield Row(session_id=key[0], phase=INTERRUPTED, seq=r.seq)
            elif r.phase == RESUME and held:
                held = False
                if now >= 0:
                    yield Row(session_id=key[0], phase=self.order[now], seq=r.seq)
            elif not held and to > now:
                now = to
                yield Row(session_id=key[0], phase=r.phase, seq=r.seq)
        self.now.update((now, held))

    def close(self) -> None:
        pass


def phases(events: DataFrame, order: list[str], idle: int = IDLE) -> DataFrame:
    """(session_id, phase, seq): changes of phase from events (session_id, phase, seq).

    A session moves to later phases only. `interrupt` holds it, events are passed over until `continue`, which sends the
    phase where it was again. A session idle for `idle` milliseconds is forgotten.
    """
    _store(events.sparkSession)
    return events.groupBy("session_id").transformWithState(_Phases(order, idle), "session_id long, phase string, seq long", "append", "processingTime")
