"""Session state as a stream: append lists, counters and last values per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "conv_id long, n_rows long, n_user long, iteration long, goal string, last_role string, recent array<string>"
_STATE = "n_rows long, n_user long, iteration long, goal string, last_role string"


class SessionFold(StatefulProcessor):
    """Folds rows of ``(conv_id, turn, role, text)`` in turn order into one state row per conversation.

    The goal is set once, counters add up, the iteration restarts at each user
    row, and the list of recent texts is a list state, capped so that it stays
    bounded. State that no batch has touched for ``ttl_ms`` is forgotten.
    """

    def __init__(self, recent: int = 8, ttl_ms: int | None = None) -> None:
        self.recent, self.ttl_ms = recent, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("session", _STATE, self.ttl_ms)
        self.texts = handle.getListState("recent", "said string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        n_rows, n_user, iteration, goal, last_role = self.state.get() if self.state.exists() else (0, 0, 0, None, None)
        recent = [said for (said,) in self.texts.get()] if self.texts.exists() else []
        batch = pd.concat(list(rows)).sort_values("turn", kind="stable")
        for role, said in zip(batch["role"], batch["text"], strict=True):
            n_rows, last_role = n_rows + 1, role
            iteration = 0 if role == "user" else iteration + 1
            if role == "user":
                n_user += 1
                goal = said[:200] if goal is None and said is not None else goal
            recent.append((said or "")[:80])
        recent = recent[-self.recent :]
        self.state.update((n_rows, n_user, iteration, goal, last_role))
        self.texts.put([(said,) for said in recent])
        yield pd.DataFrame({"conv_id": [key[0]], "n_rows": [n_rows], "n_user": [n_user], "iteration": [iteration], "goal": [goal], "last_role": [last_role], "recent": [recent]})

    def close(self) -> None:
        pass


def fold_sessions(stream: DataFrame, recent: int = 8, ttl_ms: int | None = None) -> DataFrame:
    """The current state of every conversation that a batch touched; with ``ttl_ms``, one that was silent longer starts anew."""
    time = "None" if ttl_ms is None else "ProcessingTime"
    return stream.groupBy("conv_id").transformWithStateInPandas(SessionFold(recent, ttl_ms), SCHEMA, "Update", time)


ENDED = "conv_id long, started timestamp, ended timestamp, n_rows long, n_user long, goal string, last_role string"


class SessionEnd(StatefulProcessor):
    """Folds rows of ``(conv_id, ts, turn, role, text)`` into sessions, and emits one when it has been silent for ``gap_ms`` of event time.

    A row keeps its session open until its own time plus the gap; the timer of a
    session is moved whenever a later row comes. When the watermark passes it, the
    session is emitted once and its state is deleted, so that a row after it begins another
    session. Inside a batch the rows go by (ts, turn), and a gap between two of them closes the session just so.
    """

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "started long, last long, n_rows long, n_user long, goal string, last_role string")

    def _row(self, key: tuple, held: tuple) -> pd.DataFrame:
        started, last, n_rows, n_user, goal, last_role = held
        times = pd.to_datetime([started, last], unit="us")
        return pd.DataFrame({"conv_id": [key[0]], "started": [times[0]], "ended": [times[1]], "n_rows": [n_rows], "n_user": [n_user], "goal": [goal], "last_role": [last_role]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held = self.state.get() if self.state.exists() else None
        batch = pd.concat(list(rows))
        batch["at"] = batch["ts"].astype("datetime64[us]").astype("int64")
        for at, role, said in batch.sort_values(["at", "turn"], kind="stable")[["at", "role", "text"]].itertuples(index=False):
            if held is not None and at - held[1] > self.gap_ms * 1000:
                yield self._row(key, held)
                held = None
            started, last, n_rows, n_user, goal, _ = held or (at, at, 0, 0, None, None)
            goal = said[:200] if goal is None and role == "user" and said is not None else goal
            held = (min(started, at), max(last, at), n_rows + 1, n_user + (role == "user"), goal, role)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[1] // 1000 + self.gap_ms + 1)  # a row just at the gap still belongs
        self.state.update(held)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        if self.state.exists():
            yield self._row(key, self.state.get())
            self.state.clear()

    def close(self) -> None:
        pass


def end_sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = "1 minute") -> DataFrame:
    """Sessions of a stream ``(conv_id, ts, turn, role, text)`` that have ended: silent for longer than the gap, by event time.

    Rows that come later than ``delay`` behind the watermark are dropped by it. A session that is still open is not
    emitted. The batch twin is ``operators.sessions.gap_sessions``.
    """
    gap_ms = int(pd.Timedelta(gap) / pd.Timedelta(milliseconds=1))
    return stream.withWatermark("ts", delay).groupBy("conv_id").transformWithStateInPandas(SessionEnd(gap_ms), ENDED, "Append", "EventTime")
