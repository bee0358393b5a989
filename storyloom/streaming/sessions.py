"""Crawl sessions, heartbeats, progress views and monitors as folds: the same over a table and over a stream."""

from __future__ import annotations

from .ordered import NEVER, Fold

#: Seconds that a session lasts at most, and of silence before a heartbeat; log lines that a view keeps.
TTL, BEAT, LINES = 7200, 15, 200


class Sessions(Fold):
    """A task's session begins with its first event and closes with a finishing one, or a fixed time after it began.

    Rows tell of heartbeats, one for each ``beat`` seconds of silence while the session lasts, and of its close.
    """

    memory = "open boolean, started bigint, last bigint, events bigint, beats bigint"
    told = "kind string, at timestamp, started timestamp, events bigint, finished boolean"

    def __init__(self, finishing: tuple[str, ...], ttl: int = TTL, beat: int = BEAT):
        self.finishing, self.ttl, self.beat = finishing, ttl * 1_000_000, beat * 1_000_000

    def begin(self):
        return False, 0, 0, 0, 0

    def until(self, state, time):
        """Beats before ``time``, and the close where the session's time is over before it."""
        is_open, started, last, events, beats = state
        if not is_open:
            return state, []
        out, end = [], started + self.ttl
        while (at := last + (beats + 1) * self.beat) < time and at <= end:
            beats += 1
            out.append(("heartbeat", at, started, events, False))
        if end < time:
            return self.begin(), [*out, ("closed", end, started, events, False)]
        return (True, started, last, events, beats), out

    def row(self, state, time, order, kind):
        is_open, started, _, events, _ = state
        started, events = (started, events + 1) if is_open else (time, 1)
        if kind in self.finishing:
            return self.begin(), [("closed", time, started, events, True)]
        return (True, started, time, events, 0), []

    def wake(self, state):
        if not state[0]:
            return NEVER
        return min(state[2] + (state[4] + 1) * self.beat, state[1] + self.ttl) + 1


class Progress(Fold):
    """What a viewer of a task sees after each of its events: figures, state, and the last lines of its log."""

    memory = "current bigint, total bigint, speed double, eta string, status string, log array<string>"
    told = f"event_id bigint, {memory}"

    def __init__(self, lines: int = LINES):
        self.lines = lines

    def begin(self):
        return 0, 0, 0.0, "--", "connecting", []

    def row(self, state, time, order, kind, message, index, total_said, speed_said, eta_said, status_said):
        current, total, speed, eta, status, log = state
        said = [message]
        if kind == "start":
            status = "running"
        elif kind == "status":
            if status_said == "completed":
                status, said = "completed", [message, f"done: {message}"]
            elif status_said == "failed":
                status = "failed"
        elif kind == "progress":
            total = int(total_said or 0)
        elif kind == "chapter":
            current, total, speed = int(index or 0), int(total_said or 0) or total, float(speed_said or 0)
            eta = f"{int(eta_said)}s" if eta_said else "--"
        elif kind == "error":
            status = "failed"
        else:  # heartbeats and the end of the stream leave no line
            said = []
        log = [*log, *said][-self.lines :]
        state = current, total, speed, eta, status, log
        return state, [(order, *state)]


class LastViews(Progress):
    """The view after the last of the events that came by together, with that event: none between is told."""

    memory = told = Progress.told

    def begin(self):
        return None, *super().begin()

    def row(self, state, time, order, *values):
        view, _ = super().row(state[1:], time, order, *values)
        return (order, *view), []

    def rest(self, state):
        return [state]


class Monitor(Fold):
    """Differences of a queue's counters between one snapshot and the next, the speed, and the time that the rest would take."""

    memory = "seen boolean, at bigint, pending bigint, completed bigint, failed bigint"
    told = "taken timestamp, seconds double, new_pending bigint, new_completed bigint, new_failed bigint, per_second double, eta_seconds double"

    def begin(self):
        return False, 0, 0, 0, 0

    def row(self, state, time, order, pending, completed, failed):
        seen, at, *before = state
        now = (int(pending), int(completed), int(failed))
        if not seen:
            return (True, time, *now), [(time, None, 0, 0, 0, None, None)]
        seconds = (time - at) / 1e6
        rate = (now[1] - before[1]) / seconds if seconds > 0 else None
        eta = now[0] / rate if rate and rate > 0 else None
        return (True, time, *now), [(time, seconds, *(x - y for x, y in zip(now, before, strict=True)), rate, eta)]
