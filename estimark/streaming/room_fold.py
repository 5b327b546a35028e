"""The room fold as keyed state of the streaming engine.

``RoomFold`` holds the state of one room in the state store: the open segment,
its tasks and the last vote of each person per task.  Every command of a
micro-batch is applied once, in (ts, event_id) order, and what it changed is
emitted; a batch costs its commands, not the rooms' history.  A task keeps the
counts of its members' current scores, so the median at its first completion
is read off without looking at the votes.  A running time box is an event-time
timer at the first whole second beyond the deadline: when the watermark gets
there and the segment is still open, it is reported as overrun, once.

``RoomView`` takes the emitted changes, room by room, and keeps the digest of
the room's view: after every command it emits the cell that changed and the
digest of the whole view, which is what connected clients get.

``PackedRoomFold`` and ``PackedRoomView`` are the same processors over blocks of
rows, written as JSON: most of a processor's time goes into single cells that
cross between the engine and its process, so a command is one cell there, and a
block of up to ``BLOCK`` changes is one cell back.

The rules are those of ``estimark.operators.fold``.  Commands older than the
watermark are dropped by the engine, so the delay says how late a message may
be.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from estimark.operators.fold import FINISH, START, STOP, VOTE

COMMANDS = ("room_id long, at timestamp, us long, event_id long, person_no long, kind string, start_task long, minutes int, "
            "has_slot boolean, vote boolean, score int, is_card boolean")
CHANGES = ("what string, room_id long, at timestamp, us long, seq long, event_id long, kind string, seg long, task_id long, "
           "person_no long, vote boolean, score int, old_vote boolean, old_score int, active_task long, on_active boolean, "
           "completed boolean, n_segments long, first_done boolean, median double, flags string")
VIEWS = ("room_id long, at timestamp, us long, seq long, event_id long, kind string, task_id long, person_no long, vote boolean, "
         "score int, active_task long, n_cells long, sum_scores long, n_completed long, finished boolean, digest long")

PACKED = "room_id long, at timestamp, rows string"
BLOCK = 1000  # rows of a packed block at most

_ROOM = "n long, markers long, open_task long, open_seg long, opened_us long, box_s long, due_ms long, finished boolean"
_TASK = "n_segments long, completed boolean, median double, scores array<int>, counts array<long>"
_CHANGE_NAMES = [c.split()[0] for c in CHANGES.split(", ")]
_VIEW_NAMES = [c.split()[0] for c in VIEWS.split(", ")]
_NO_COMMAND = dict.fromkeys(c.split()[0] for c in COMMANDS.split(", "))
_NO_CHANGE = dict.fromkeys(_CHANGE_NAMES)


def _row(names: list[str], values: dict) -> Row:
    return Row(**{n: values.get(n) for n in names})


def median_of_counts(counts: dict[int, int]) -> float | None:
    """The continuous median of values with frequencies."""
    left = [(v, n) for v, n in sorted(counts.items()) if n]
    total = sum(n for _, n in left)
    if not total:
        return None

    def nth(i):
        for v, n in left:
            if i < n:
                return v
            i -= n

    return (nth((total - 1) // 2) + nth(total // 2)) / 2


def _blocks(room: int, rows: Iterator[dict]) -> Iterator[Row]:
    """Rows as packed blocks, in their order.  A block's event time is its last command's; a row's is in microseconds."""
    block, latest = [], None

    def packed():
        text = json.dumps([{k: v for k, v in r.items() if v is not None} for r in block], separators=(",", ":"))
        return Row(room_id=room, at=latest, rows=text)

    for r in rows:
        at, us = r.pop("at"), r.pop("at_us")
        latest = at if latest is None or r.get("what") != "overrun" else latest
        block.append(r | {"at": us})
        if len(block) == BLOCK:
            yield packed()
            block, latest = [], None
    if block:
        yield packed()


class RoomFold(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.room = handle.getValueState("room", _ROOM)
        self.tasks = handle.getMapState("tasks", "task_id long", _TASK)
        self.votes = handle.getMapState("votes", "task_id long, person_no long", "vote boolean, score int")

    def _load(self) -> dict:
        names = [c.split()[0] for c in _ROOM.split(", ")]
        if self.room.exists():
            return dict(zip(names, self.room.get()))
        return dict.fromkeys(names) | {"n": 0, "markers": 0, "finished": False}

    def _task(self, held: dict, task: int) -> dict:
        if task not in held:
            if self.tasks.containsKey((task,)):
                n, completed, median, scores, counts = self.tasks.getValue((task,))
                held[task] = {"n_segments": n, "completed": completed, "median": median,
                              "counts": dict(zip(scores or [], counts or []))}
            else:
                held[task] = {"n_segments": 0, "completed": False, "median": None, "counts": {}}
        return held[task]

    def _close(self, s: dict, us: int | None) -> list[dict]:
        """End the open segment; an overrun that no timer has reported yet is reported."""
        out = []
        if s["due_ms"] is not None:
            if us is not None and us // 1000 >= s["due_ms"]:
                out.append(self._overrun(s))
            self.handle.deleteTimer(s["due_ms"])
        s.update(open_task=None, due_ms=None, box_s=None)
        return out

    def _overrun(self, s: dict) -> dict:
        at = dt.datetime.fromtimestamp(s["due_ms"] / 1000)
        return {"what": "overrun", "room_id": self.key, "at": at, "at_us": 1000 * s["due_ms"], "us": s["opened_us"], "seg": s["open_seg"], "task_id": s["open_task"]}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in self._applied(key[0], [r.asDict() for r in rows]):
            yield _row(_CHANGE_NAMES, r)

    def _applied(self, room: int, commands: list[dict]) -> list[dict]:
        """Apply the commands of a micro-batch; what they changed."""
        self.key = room
        s, tasks, votes, touched, out = self._load(), {}, {}, {}, []
        for r in sorted(commands, key=lambda r: (r["us"], r["event_id"])):
            kind, flags = r["kind"], []
            change = {"what": "change", "room_id": self.key, "at": r["at"], "at_us": r["us"], "us": r["us"], "event_id": r["event_id"], "kind": kind,
                      "person_no": r["person_no"]}
            s["n"] += 1
            if kind in (START, STOP):
                s["markers"] += 1
                closed = s["open_task"]
                out += self._close(s, r["us"])
                if closed is not None:
                    touched[closed] = True
                if kind == START:
                    task = r["start_task"]
                    flags = (["unknown_ordinal"] if task is None else []) + (["overlapping_start"] if closed is not None else [])
                    if task is not None:
                        t = self._task(tasks, task)
                        flags += ["already_completed"] if t["completed"] else []
                        t["n_segments"] += 1
                        touched[task] = True
                        s.update(open_task=task, open_seg=s["markers"], opened_us=r["us"], box_s=None)
                        if r["minutes"] is not None:
                            s["box_s"] = 60 * int(r["minutes"])
                            s["due_ms"] = 1000 * (r["us"] // 1_000_000 + s["box_s"] + 1)
                            self.handle.registerTimer(s["due_ms"])
                    change["task_id"] = task
                elif closed is not None:
                    t = self._task(tasks, closed)
                    change["task_id"] = closed
                    if not t["completed"]:
                        t["completed"], t["median"] = True, median_of_counts(t["counts"])
                        change |= {"first_done": True, "median": t["median"]}
            elif kind == VOTE:
                task = s["open_task"]
                flags = ["no_active_task"] if task is None else [] if r["has_slot"] else ["no_slot"]
                if not flags:
                    cell = (task, r["person_no"])
                    if cell not in votes:
                        votes[cell] = self.votes.getValue(cell) if self.votes.containsKey(cell) else None
                    old, t = votes[cell], self._task(tasks, task)
                    if old is not None:
                        change |= {"old_vote": old[0], "old_score": old[1]}
                        if old[1] in t["counts"]:
                            t["counts"][old[1]] -= 1
                    if r["is_card"] and r["score"] is not None:
                        t["counts"][r["score"]] = t["counts"].get(r["score"], 0) + 1
                    votes[cell] = (r["vote"], r["score"])
                    change |= {"task_id": task, "vote": r["vote"], "score": r["score"]}
            elif kind == FINISH:
                s["finished"] = True
            out.append(change | {"seq": s["n"], "seg": s["markers"], "active_task": s["open_task"], "flags": ",".join(flags)})
        for task in touched:
            t = self._task(tasks, task)
            out.append({"what": "task", "room_id": self.key, "at": r["at"], "at_us": r["us"], "us": r["us"], "seq": s["n"], "task_id": task, "on_active": s["open_task"] == task,
                        "completed": t["completed"], "n_segments": t["n_segments"], "median": t["median"]})
        for task, t in tasks.items():
            kept = {v: n for v, n in t["counts"].items() if n}
            self.tasks.updateValue((task,), (t["n_segments"], t["completed"], t["median"], list(kept), list(kept.values())))
        for cell, v in votes.items():
            if v is not None:
                self.votes.updateValue(cell, v)
        self.room.update(tuple(s.values()))
        return out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for r in self._expired(key[0], expiredTimerInfo.getExpiryTimeInMs()):
            yield _row(_CHANGE_NAMES, r)

    def _expired(self, room: int, ms: int) -> list[dict]:
        self.key, s = room, self._load()
        if s["open_task"] is None or s["due_ms"] != ms:
            return []
        out = [self._overrun(s)]
        s["due_ms"] = None
        self.room.update(tuple(s.values()))
        return out

    def close(self) -> None:
        pass


class PackedRoomFold(RoomFold):
    """``RoomFold`` from rows (room_id, at, a command as JSON) to rows of ``PACKED``."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        commands = [_NO_COMMAND | json.loads(text) | {"at": at} for _, at, text in rows]
        yield from _blocks(key[0], self._applied(key[0], commands))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from _blocks(key[0], self._expired(key[0], expiredTimerInfo.getExpiryTimeInMs()))


DIGEST = 1 << 48


def cell_hash(text: str) -> int:
    """48 bits of a cell of the view; the digest of a view is the sum over its cells."""
    return int(hashlib.md5(text.encode()).hexdigest()[:12], 16)


def _text(v) -> str:
    return "none" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


class RoomView(StatefulProcessor):
    _STATE = "cells long, n_cells long, sum_scores long, n_completed long, finished boolean"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("view", self._STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in self._viewed([r.asDict() for r in rows]):
            yield _row(_VIEW_NAMES, r)

    def _viewed(self, changes: list[dict]) -> list[dict]:
        """The view after each change of a micro-batch."""
        total, n_cells, scores, completed, finished = self.state.get() if self.state.exists() else (0, 0, 0, 0, False)
        out = []
        for r in sorted(changes, key=lambda r: r["seq"]):
            task = r["task_id"]
            if r["kind"] == VOTE and task is not None:
                vote = lambda v, x: cell_hash(f"v|{task}|{r['person_no']}|{_text(v)}|{_text(x)}")
                total += vote(r["vote"], r["score"])
                scores += r["score"] or 0
                if r["old_vote"] is None and r["old_score"] is None:
                    n_cells += 1
                else:
                    total -= vote(r["old_vote"], r["old_score"])
                    scores -= r["old_score"] or 0
            elif r["kind"] == STOP and r["first_done"]:
                completed += 1
                total += cell_hash(f"t|{task}|" + ("none" if r["median"] is None else f"{r['median']:.2f}"))
            elif r["kind"] == FINISH:
                finished = True
            digest = total + cell_hash(f"a|{_text(r['active_task'])}") + (cell_hash("f") if finished else 0)
            out.append({c: r[c] for c in (*_VIEW_NAMES, "at_us") if c in r} | {
                "n_cells": n_cells, "sum_scores": scores, "n_completed": completed, "finished": finished, "digest": digest % DIGEST})
        self.state.update((total % DIGEST, n_cells, scores, completed, finished))
        return out

    def close(self) -> None:
        pass


class PackedRoomView(RoomView):
    """``RoomView`` from rows of ``PACKED`` (blocks of changes) to rows of ``PACKED`` (blocks of views)."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        changes = [_NO_CHANGE | r | {"at": at, "at_us": r.get("at")} for _, at, text in rows for r in json.loads(text)
                   if r["what"] == "change"]
        if changes:
            yield from _blocks(key[0], self._viewed(changes))
