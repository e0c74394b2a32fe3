"""The calls that a key of ``SessionTimers`` makes to the state don't grow with its events."""

from types import SimpleNamespace

from millrace.streaming.arrivals import SessionTimers

MINUTE = 60_000_000


class State:
    """One value and a set of timers, which count the calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, due):
        self.calls += 1
        self.timers.add(due)

    def deleteTimer(self, due):
        self.calls += 1
        self.timers.remove(due)


def test_calls_of_many_sessions():
    state = State()
    sessions = SessionTimers(30 * MINUTE)
    sessions.init(state)
    rows = lambda ts: iter([SimpleNamespace(t=t) for t in ts])
    at = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms, getExpiryTimeInMs=lambda: ms)
    list(sessions.handleInputRows((7,), rows([k * 60 * MINUTE for k in reversed(range(1, 501))]), None))
    assert state.calls <= 4 and len(state.timers) == 1
    list(sessions.handleInputRows((7,), rows([50 * MINUTE, 90 * MINUTE]), None))  # one extends the first; 30 minutes are a gap
    assert state.calls <= 8 and state.timers == {90 * 60_000}
    due = state.timers.pop()
    early = list(sessions.handleExpiredTimer((7,), at(300 * 60_000), at(due)))
    assert [(r.user_id, r.start // MINUTE, r.last // MINUTE, r.n) for r in early] == [(7, 50, 60, 2), (7, 90, 90, 1), (7, 120, 120, 1), (7, 180, 180, 1), (7, 240, 240, 1)]
    assert state.calls <= 11 and state.timers == {330 * 60_000}
    late = list(sessions.handleExpiredTimer((7,), at(10**10), at(state.timers.pop())))
    assert len(late) == 496 and state.value is None and not state.timers and state.calls <= 13
