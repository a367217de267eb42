"""Stateful processors. Each handles the rows of a key, or of many, in arrival order and keeps only
bounded state; the trigger's rate limit bounds the rows of one call."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SESSION_OUT = "pos bigint, opened bigint, history bigint, superseded bigint"
REVISION_OUT = "session_id bigint, arrival bigint, utterance_id int, revision int, accepted boolean"
COMMIT_OUT = "generation bigint, committed_id bigint, utterances bigint, text string, rejected boolean"
TRANSCRIPT_OUT = "stream bigint, arrival bigint, text string, language string"
ANSWER_OUT = "outcome string, answer string"
SEGMENT_OUT = "start bigint, end bigint, blocks bigint"
FINAL_TYPES = ("turn.completed", "turn.failed", "turn.cancelled")


def unpacked(frame: pd.DataFrame) -> pd.DataFrame:
    """The rows of packs (``n_rows`` of them each, columns as lists); a frame of plain rows as it is."""
    if "n_rows" not in frame.columns:
        return frame
    names = [c for c in frame.columns if c not in ("n_slot", "n_rows", "ts")]
    return pd.DataFrame({name: np.concatenate([np.asarray(cell) for cell in frame[name]]) for name in names})


def in_order(rows: Iterator[pd.DataFrame], *order: str) -> Iterator[Any]:
    frames = [unpacked(frame) for frame in rows if len(frame)]
    if not frames:
        return iter(())
    return pd.concat(frames).sort_values(list(order), kind="stable").itertuples(index=False)


class Ending(StatefulProcessor):
    """A processor whose state of a key ends: once the watermark is ``idle`` micros past the
    key's last event, a timer clears all of it. Without ``idle`` a key is kept for good, which
    only a bounded set of keys allows. Events carry their time as ``t_us``."""

    def __init__(self, idle: int | None = None) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> list:
        """Open the states; all that is returned is cleared when the key ends."""
        raise NotImplementedError

    def rest(self, last: int, wait: int | None = None) -> None:
        """Have the only timer of the key fire ``wait`` (or ``idle``) micros after ``last``."""
        wait = self.idle if wait is None else wait
        if wait is None:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(-(-(last + wait) // 1000))

    def end(self) -> None:
        for state in self.states:
            state.clear()
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.states:
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _latest(events: list) -> int:
    return max(int(event.t_us) for event in events)


class Sharing(Ending):
    """A processor whose calls are given the rows of many keys, as calls cost more than rows do.

    Keys are told apart by ``names``, which are texts. State is held in lists whose rows begin
    with the key; the only timer fires at the first time at which something of a key is due."""

    def __init__(self, names: list[str], idle: int | None = None) -> None:
        super().__init__(idle)
        self.names = names

    def listed(self, handle: StatefulProcessorHandle, name: str, fields: str):
        keys = ", ".join(f"key{i} string" for i in range(len(self.names)))
        return handle.getListState(name, f"{keys}, {fields}")

    def key_of(self, event) -> tuple:
        return tuple(v if isinstance(v, str) else None for v in (getattr(event, name) for name in self.names))

    def held(self, state) -> Iterator[tuple[tuple, tuple]]:
        n = len(self.names)
        return ((tuple(row[:n]), tuple(row[n:])) for row in state.get())

    @staticmethod
    def keep(state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def due(self, micros: int) -> int:
        return -(-micros // 1000)

    def wake(self, dues: list[int]) -> None:
        """Have the only timer fire at the first of these times; none are given if no timer is needed."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if dues:
            self.handle.registerTimer(min(dues))

    @staticmethod
    def passed(timerValues, expiredTimerInfo) -> int:
        return max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())


class SessionStore(Sharing):
    """The event that opened the session, bounded history size and superseded turn per event.
    A session expires after ``ttl`` micros of silence unless a turn is active; an event-time
    timer then drops its state. One with an active turn is kept until the turn ends, but for
    no longer than ``idle`` micros of silence. A call holds many sessions."""

    def __init__(self, names: list[str], ttl: int, max_turns: int = 20, idle: int | None = None) -> None:
        super().__init__(names, ttl)
        self.ttl, self.max_turns, self.longest = ttl, max_turns, idle

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.state = self.listed(handle, "session", "opened bigint, last_seen bigint, active bigint")
        self.turns = self.listed(handle, "turns", "turn_no bigint, pos bigint")
        return [self.state, self.turns]

    def _sessions(self) -> dict[tuple, list]:
        """[opened, last seen, active turn, history] of every session that is held."""
        sessions = {key: [*value, []] for key, value in self.held(self.state)}
        for key, turn in self.held(self.turns):
            sessions[key][3].append(turn)
        return sessions

    def _store(self, sessions: dict[tuple, list]) -> None:
        self.keep(self.state, [(*key, *value[:3]) for key, value in sessions.items()])
        self.keep(self.turns, [(*key, *turn) for key, value in sessions.items() for turn in value[3]])
        ends = [self._end(value) for value in sessions.values()]
        self.wake([end for end in ends if end is not None])

    def _end(self, session: list) -> int | None:
        if session[2] < 0:
            return self.due(session[1] + self.ttl)
        # an active session does not expire by silence of ttl
        return None if self.longest is None else self.due(session[1] + max(self.ttl, self.longest))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions = self._sessions()
        out = []
        for event in in_order(rows, "pos"):
            mine = self.key_of(event)
            first, seen, active, history = sessions.get(mine) or (None, 0, -1, [])
            if first is None or (event.t_us - seen >= self.ttl and active < 0):
                first, history = int(event.pos), []
            replaced = -1
            if event.type == "turn.started":
                replaced, active = active, int(event.turn_no)
            elif event.type in FINAL_TYPES:
                if event.type == "turn.completed":
                    history = [*history, (int(event.turn_no), int(event.pos))][-self.max_turns :]
                active = -1
            sessions[mine] = [first, int(event.t_us), active, history]
            out.append((*mine, event.pos, first, len(history), replaced))
        self._store(sessions)
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "pos", "opened", "history", "superseded"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues, expiredTimerInfo)
        sessions = self._sessions()
        ends = {mine: self._end(session) for mine, session in sessions.items()}
        self._store({k: v for k, v in sessions.items() if ends[k] is None or ends[k] > passed})
        return iter(())


class RevisionFilter(Ending):
    """Marks every partial as accepted or stale."""

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.state = handle.getValueState("best", "utterance_id int, revision int, closed int")
        return [self.state]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best_id, best_revision, closed = self.state.get() if self.state.exists() else (0, -1, 0)
        out = []
        events = list(in_order(rows, "arrival"))
        for event in events:
            utterance, revision = int(event.utterance_id), int(event.revision)
            newer = (utterance, revision) > (best_id, best_revision)
            accepted = utterance > 0 and utterance > closed and newer
            if utterance > 0 and newer:
                best_id, best_revision = utterance, revision
            if event.is_final and utterance > closed:
                closed = utterance
            out.append((key[0], event.arrival, utterance, revision, accepted))
        if out:
            self.state.update((best_id, best_revision, closed))
            if self.idle is not None:
                self.rest(_latest(events))
            yield pd.DataFrame(out, columns=["session_id", "arrival", "utterance_id", "revision", "accepted"])


class BatchCommit(Sharing):
    """Commits a batch when no utterance is open or pending. ``kind``: start, final, or
    reset (typed text, interrupt, cancel), which raises the generation and drops the batch;
    finals of an older generation are ignored. A call holds many sessions."""

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.texts = self.listed(handle, "texts", "utterance_id bigint, text string")
        self.open = self.listed(handle, "open", "utterance_id bigint, generation bigint")
        self.generation = self.listed(handle, "generation", "generation bigint, last bigint")
        return [self.texts, self.open, self.generation]

    def _sessions(self) -> dict[tuple, list]:
        """[generation, last event, texts, open utterances] of every session that is held."""
        sessions = {key: [*value, {}, {}] for key, value in self.held(self.generation)}
        for key, (utterance, text) in self.held(self.texts):
            sessions[key][2][utterance] = text
        for key, (utterance, generation) in self.held(self.open):
            sessions[key][3][utterance] = generation
        return sessions

    def _store(self, sessions: dict[tuple, list]) -> None:
        self.keep(self.generation, [(*key, *value[:2]) for key, value in sessions.items()])
        self.keep(self.texts, [(*key, *each) for key, value in sessions.items() for each in value[2].items()])
        self.keep(self.open, [(*key, *each) for key, value in sessions.items() for each in value[3].items()])
        if self.idle is not None:
            self.wake([self.due(value[1] + self.idle) for value in sessions.values()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sessions = self._sessions()
        out = []
        touched: dict[tuple, int] = {}
        for event in in_order(rows, "t_us", "kind_order", "utterance_id"):
            mine = self.key_of(event)
            session = sessions.setdefault(mine, [0, 0, {}, {}])
            generation, _, texts, pending = session
            utterance = int(event.utterance_id)
            touched[mine] = int(event.t_us)
            if event.kind == "reset":
                session[0], session[2], session[3] = generation + 1, {}, {}
            elif event.kind == "start":
                pending[utterance] = generation
            elif pending.pop(utterance, None) == generation:
                texts[utterance] = event.text or ""
                if not pending:
                    spoken = [texts[i].strip() for i in sorted(texts) if texts[i].strip()]
                    out.append((*mine, generation, max(texts), len(texts), " ".join(spoken), not spoken))
                    session[2] = {}
        for mine, last in touched.items():
            sessions[mine][1] = last
        self._store(sessions)
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "generation", "committed_id", "utterances", "text", "rejected"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues, expiredTimerInfo)
        self._store({k: v for k, v in self._sessions().items() if self.due(v[1] + self.idle) > passed})
        return iter(())


def _store(state, values: dict) -> None:
    state.clear()
    for name, value in values.items():
        state.updateValue((name,), (value,))


class Transcript(Ending):
    """Current transcript of one utterance after range replacements, once per trigger."""

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.pieces = handle.getMapState("pieces", "sn int", "text string")
        self.tags = handle.getMapState("tags", "sn int", "language string, placed bigint")
        return [self.pieces, self.tags]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = {k[0]: v[0] for k, v in self.pieces.iterator()}
        tags = {k[0]: tuple(v) for k, v in self.tags.iterator()}
        last = -1
        events = list(in_order(rows, "arrival"))
        if not events:
            return
        for event in events:
            last = int(event.arrival)
            if event.pgs == "rpl" and not pd.isna(event.rg_start):
                for number in range(int(event.rg_start), int(event.rg_end) + 1):
                    pieces.pop(number, None)
                    tags.pop(number, None)
            if event.word:
                pieces[int(event.sn)] = event.word
            if event.lg:
                number = int(event.sn)
                tags[number] = (event.lg, tags[number][1] if number in tags else last)
        _store(self.pieces, pieces)
        self.tags.clear()
        for number, value in tags.items():
            self.tags.updateValue((number,), value)
        if self.idle is not None:
            self.rest(_latest(events))
        counts: dict[str, list[int]] = {}
        for tag, placed in sorted(tags.values(), key=lambda t: t[1]):
            counts.setdefault(tag, [0, placed])[0] += 1
        language = max(counts, key=lambda t: counts[t][0]) if counts else ""
        text = "".join(pieces[number] for number in sorted(pieces)).strip()
        yield pd.DataFrame([(key[0], last, text, language)], columns=["stream", "arrival", "text", "language"])


class AnswerAssembly(Sharing):
    """Collects the deltas of a turn and emits the answer at its first terminal event.
    A call holds many turns."""

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.deltas = self.listed(handle, "deltas", "text string, last bigint")
        self.done = self.listed(handle, "done", "last bigint")
        return [self.deltas, self.done]

    def _turns(self) -> tuple[dict[tuple, list], dict[tuple, int]]:
        """[deltas, last event] of every turn that is open, and the last event of every one that is done."""
        turns: dict[tuple, list] = {}
        for key, (text, last) in self.held(self.deltas):
            turns.setdefault(key, [[], last])[0].append(text)
        return turns, {key: last for key, (last,) in self.held(self.done)}

    def _store(self, turns: dict[tuple, list], done: dict[tuple, int]) -> None:
        self.keep(self.deltas, [(*key, text, last) for key, (texts, last) in turns.items() for text in texts])
        self.keep(self.done, [(*key, last) for key, last in done.items()])
        if self.idle is not None:
            lasts = [last for texts, last in turns.values() if texts] + list(done.values())
            self.wake([self.due(min(lasts) + self.idle)] if lasts else [])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        turns, done = self._turns()
        out = []
        latest: dict[tuple, int] = {}
        for event in in_order(rows, "pos"):
            mine = self.key_of(event)
            if self.idle is not None:
                latest[mine] = max(int(event.t_us), latest.get(mine, 0))
            if mine in done:
                continue
            if event.type in FINAL_TYPES:
                texts, _ = turns.pop(mine, ([], 0))
                done[mine] = 0
                out.append((*mine, event.type, "".join(texts)))
            elif event.type == "response.text.delta" and event.delta:
                turns.setdefault(mine, [[], 0])[0].append(event.delta)
        for mine, last in latest.items():
            if mine in done:
                done[mine] = last
            elif mine in turns:
                turns[mine][1] = last
        self._store(turns, done)
        if out:
            yield pd.DataFrame(out, columns=[*self.names, "outcome", "answer"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues, expiredTimerInfo)
        turns, done = self._turns()
        self._store(
            {k: v for k, v in turns.items() if self.due(v[1] + self.idle) > passed},
            {k: last for k, last in done.items() if self.due(last + self.idle) > passed},
        )
        return iter(())


class CappedSegments(Sharing):
    """Segments closed by silence or by the length cap; a segment is emitted when the next
    one starts. With ``timed`` an event-time timer emits it as soon as no event can join it
    any more, and drops its state. A call holds many sessions."""

    def __init__(self, names: list[str], gap: int, cap: int, timed: bool = False) -> None:
        super().__init__(names, gap if timed else None)
        self.gap, self.cap = gap, cap

    def opened(self, handle: StatefulProcessorHandle) -> list:
        self.state = self.listed(handle, "segment", "start bigint, last bigint, blocks bigint")
        return [self.state]

    def _end(self, segment: tuple) -> int:
        return self.due(min(segment[1] + self.gap + 1, segment[0] + self.cap))

    def _store(self, segments: dict[tuple, tuple]) -> None:
        self.keep(self.state, [(*key, *value) for key, value in segments.items()])
        if self.idle is not None:
            self.wake([self._end(value) for value in segments.values()])

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.names, "start", "end", "blocks"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        segments = dict(self.held(self.state))
        out = []
        for event in in_order(rows, "pos"):
            mine, now = self.key_of(event), int(event.t_us)
            start, last, blocks = segments.get(mine, (now, now, 0))
            if blocks and (now - last > self.gap or now - start >= self.cap):
                out.append((*mine, start, last, blocks))
                start, blocks = now, 0
            segments[mine] = start, now, blocks + 1
        self._store(segments)
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = self.passed(timerValues, expiredTimerInfo)
        segments = dict(self.held(self.state))
        over = {k: v for k, v in segments.items() if self._end(v) <= passed}
        self._store({k: v for k, v in segments.items() if k not in over})
        if over:
            yield self._frame([(*k, *v) for k, v in over.items()])


class Attempts(Ending):
    """Outcome of each attempt of a request: ``completed`` if an output with text comes within
    ``timeout`` micros of its start, ``empty_stream`` if it ends before without one, otherwise
    ``first_token_timeout``, settled by a timer where nothing more comes. Only an attempt that
    has put nothing out is retried, and at most ``attempts`` (1 or 2) are made.

    ``kind``: start, delta or end. A settled attempt leaves no state; its later events are ignored.

    A call is given the rows of many requests, as calls cost more than rows do. Requests are
    told apart by ``names``, which are texts; the state holds the attempts that wait.
    """

    def __init__(self, names: list[str], timeout: int, attempts: int) -> None:
        super().__init__(timeout)
        self.names, self.timeout, self.attempts = names, timeout, min(max(attempts, 1), 2)

    def opened(self, handle: StatefulProcessorHandle) -> list:
        keys = ", ".join(f"key{i} string" for i in range(len(self.names)))
        self.state = handle.getListState("attempt", f"{keys}, attempt int, start bigint")
        return [self.state]

    def _settled(self, key, attempt: int, start: int, outcome: str) -> tuple:
        return (*key, attempt, start, outcome, outcome != "completed" and attempt < self.attempts)

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*self.names, "attempt", "start_us", "outcome", "retried"])

    def _due(self, start: int) -> int:
        return -(-(start + self.timeout + 1) // 1000)

    def _waiting(self) -> dict[tuple, tuple[int, int]]:
        n = len(self.names)
        return {tuple(row[:n]): (row[n], row[n + 1]) for row in self.state.get()}

    def _keep(self, waiting: dict[tuple, tuple[int, int]]) -> None:
        self.state.put([(*key, *value) for key, value in waiting.items()])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = self._waiting()
        out = []
        for event in in_order(rows, "t_us", "kind_order", "attempt"):
            now = int(event.t_us)
            mine = tuple(v if isinstance(v, str) else None for v in (getattr(event, name) for name in self.names))
            held = waiting.get(mine)
            if event.kind == "start":
                if held is not None:
                    out.append(self._settled(mine, *held, "first_token_timeout"))
                waiting[mine] = int(event.attempt), now
            elif held is not None and int(event.attempt) == held[0] and (event.kind == "end" or event.text):
                outcome = "completed" if event.kind == "delta" else "empty_stream"
                out.append(self._settled(mine, *held, outcome if now - held[1] <= self.timeout else "first_token_timeout"))
                del waiting[mine]
        if waiting:
            self._keep(waiting)
            self.rest(min(start for _, start in waiting.values()), self.timeout + 1)
        else:
            self.end()
        if out:
            yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        waiting = self._waiting()
        over = {k: v for k, v in waiting.items() if self._due(v[1]) <= passed}
        left = {k: v for k, v in waiting.items() if k not in over}
        if left:
            self._keep(left)
            self.handle.registerTimer(min(self._due(start) for _, start in left.values()))
        else:
            self.state.clear()
        if over:
            yield self._frame([self._settled(k, *v, "first_token_timeout") for k, v in over.items()])
