from datetime import datetime, timedelta

from shelfmark.streaming import counters

SCHEMA = "id string, user string, agent string, at timestamp"


def events(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(f"n{i % 7}", f"u{i % 3}", "Mozilla" if i % 4 else "Googlebot", t + timedelta(seconds=20 * i)) for i in range(30)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "in"))
    return rows, counters.stream_of(spark, str(tmp_path / "in"), SCHEMA)


def run(stream, tmp_path, mode):
    got = []
    counters.run_available(stream, str(tmp_path / "checkpoint"), lambda df, _: got.extend(df.collect()), mode)
    return got


def test_windows(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    got = {(r.user, r.window_start): r.n for r in run(counters.denied(counters.window_counts(stream, "user", "at"), 0), tmp_path, "update")}
    want = {}
    for _, user, _, at in rows:
        key = (user, at.replace(second=0))
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_once(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    assert len(run(counters.once(stream, "id", "at"), tmp_path, "append")) == 7


def test_views(spark, tmp_path):
    rows, stream = events(spark, tmp_path)
    got = {r.user: r.views for r in run(counters.view_counts(stream, "user", "agent"), tmp_path, "update")}
    assert got == {u: sum(x == u and "bot" not in a for _, x, a, _ in rows) for u in ("u0", "u1", "u2")}


def test_denials_in_any_order_within_the_watermark(spark, tmp_path):
    t = datetime(2026, 1, 1)
    at = lambda minutes, k=0: t + timedelta(minutes=minutes, seconds=k)
    landings = [
        [("u0", at(7, k)) for k in range(3)] + [("u1", at(2, k)) for k in range(2)] + [("u2", at(7))],
        [("u0", at(1, k)) for k in range(3)] + [("u1", at(3)), ("u1", at(4)), ("u0", at(8))],  # older windows, and more of one denied before
        [("u3", at(120))],
        [("u4", at(120))],  # rows are late by the watermark of the batch before
        [("u2", at(8, k)) for k in range(3)] + [("u3", at(121, k)) for k in range(2)],  # u2 comes after the watermark
    ]
    for rows in landings:
        spark.createDataFrame(rows, "user string, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = counters.stream_of(spark, str(tmp_path / "in"), "user string, at timestamp", 1)
    got = run(counters.denied_until(stream, "user", "at", 2, 5, "30 minutes"), tmp_path, "append")
    end = lambda minutes: t + timedelta(minutes=minutes)
    assert sorted((r.key, r.until) for r in got) == [("u0", end(5)), ("u0", end(10)), ("u1", end(5)), ("u3", end(125))]


class Handle:
    """State of one key, with each call noted."""

    def __init__(self):
        self.calls, self.held, self.timers = [], None, set()

    def getValueState(self, *_):  # noqa: N802  Spark's name
        return self

    def getMapState(self, *_):  # noqa: N802  Spark's name
        raise AssertionError("a call for each window")

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def clear(self):
        self.calls.append("clear")
        self.held = None

    def registerTimer(self, at):  # noqa: N802  Spark's name
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802  Spark's name
        self.calls.append("delete")
        self.timers.remove(at)


def test_a_key_asks_its_state_once_however_many_windows_it_has():
    class At:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, denials = Handle(), counters.Denials(2, 10)
    denials.init(handle)
    batch = lambda starts, watermark: [r.until for r in denials.handleInputRows(("u",), [("u", None, s) for s in starts], At(watermark))]
    assert batch([10 * i for i in range(40)] * 2, 0) == [] and handle.calls == ["get", "update", "register"] and handle.timers == {400}
    # windows that this batch's watermark finds over still count in it, and go after it
    assert batch([0, 0, 50, 390, 400], 360) == [10, 60, 400] and handle.timers == {410} and sorted(handle.held[0]) == [360, 370, 380, 390, 400]
    assert batch([390, 390], 360) == [] and handle.calls[-1] == "get"  # denied before: nothing new to keep
    assert batch([400], 420) == [] and handle.held is None and not handle.timers
    assert batch([500], 420) == [] and handle.timers == {510}
    list(denials.handleExpiredTimer(("u",), At(510), None))
    assert handle.held is None
