"""One source with nearly all rows: windows by segments give what a loop over its rows gives, and many tasks work on it."""

import random

import pytest

from rasterloom.streaming import live, scan


@pytest.fixture(scope="module")
def numbers():
    """Sparse, uneven numbers, most of one source; some of a null source."""
    r = random.Random(21)
    rows, at = [], 0
    for _ in range(3000):
        at += r.choice([1, 2, 100_000])
        rows.append((r.choice([1] * 20 + [2, None]), at))
    return rows


def by_source(rows):
    out = {}
    for s, *rest in rows:
        out.setdefault(s, []).append(rest)
    return out


def test_segments(spark, numbers):
    df = scan.segmented(spark.createDataFrame(numbers, "s long, n long").repartition(6), "s", "n")
    sizes = [x["count"] for x in df.groupBy(scan.SEGMENT).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * sorted(sizes)[4]
    assert df.filter("s = 1").select(scan.SEGMENT).distinct().count() >= 7
    for (a, b) in zip(*[iter(df.groupBy(scan.SEGMENT).agg({"n": "min"}).orderBy(scan.SEGMENT).collect())] * 2):
        assert a[0] < b[0]


def test_captured(spark, numbers):
    r = random.Random(22)
    rows = [(s, n, r.random() < 0.7) for s, n in numbers]
    got = live.captured(spark.createDataFrame(rows, "source_id long, frame_no long, has_signal boolean").repartition(5))
    want = {(s, n) for s, own in by_source(rows).items() for (_, before), (n, now) in zip(own, own[1:]) if before and now}
    assert {(x["source_id"], x["frame_no"]) for x in got.collect()} == want and got.count() == len(want)


def test_as_of(spark, numbers):
    r = random.Random(23)
    frames = [(s, n, n) for s, n in numbers]
    settings = [(s, n + r.choice([0, 0, 1]), r.randrange(100)) for s, n in r.sample(numbers, 12)]
    got = live.as_of(spark.createDataFrame(frames, "source_id long, at long, frame_no long").repartition(5), spark.createDataFrame(settings, "source_id long, at long, value int"))
    known = by_source(settings)
    want = {(s, n): max(((t, v) for t, v in known.get(s, []) if t <= n), default=(0, None))[1] for s, n, _ in frames}
    assert {(x["source_id"], x["frame_no"]): x["value"] for x in got.collect()} == want


def test_playback(spark, numbers):
    frames = [(s, n, n) for s, n in numbers[::40]]
    last = numbers[-1][1]
    ticks = [(s, k, k * last // 200) for s in (1, 2, None) for k in range(200)]
    got = live.playback(spark.createDataFrame(frames, "source_id long, frame_no long, at long").repartition(5), spark.createDataFrame(ticks, "source_id long, tick long, at long").repartition(3))
    known, want = by_source(frames), {}
    for s in (1, 2, None):
        before = None
        for k in range(200):
            shown = max((n for n, t in known.get(s, []) if t <= k * last // 200), default=None)
            want[s, k] = shown, shown is not None and k > 0 and shown == before
            before = shown
    assert {(x["source_id"], x["tick"]): (x["frame_no"], x["repeated"]) for x in got.collect()} == want


def test_controls(spark, numbers):
    r = random.Random(24)
    rows = [(s, n, r.choice([*live.CONTROLS, "z", "z", "other"])) for s, n in numbers]
    rows[2000] = (rows[2000][0], rows[2000][1], "q")
    got = {(x["source_id"], x["seq"]): x for x in live.controls(spark.createDataFrame(rows, "source_id long, seq long, key string").repartition(5), radius=60.0).collect()}
    n = 0
    for s, own in by_source(rows).items():
        state = {"yaw": 0.0, "pitch": 0.0, "cx": 0.0, "cy": 0.0, "radius": 60.0}
        for seq, key in own:
            if key in live.CONTROLS:
                name, step = live.CONTROLS[key]
                state[name] = max(live.LEAST_RADIUS, state[name] + step) if name == "radius" else state[name] + step
            n += 1
            assert {k: round(v, 6) for k, v in state.items()} == {k: round(got[s, seq][k], 6) for k in state}
            if key == "q":
                break
    assert n == len(got)


def test_admitted_sparse_numbers(spark, numbers):
    """Blocks are by rank: sparse numbers give as few blocks as dense ones, and the depths are a loop's."""
    r = random.Random(25)
    rows = [(s, n, r.choice(["push", "push", "pop"])) for s, n in numbers]
    events = spark.createDataFrame(rows, "source_id long, seq long, kind string").repartition(5)
    got = {(x["source_id"], x["seq"]): (x["ok"], x["depth"]) for x in live.admitted(events, 4, block=16).collect()}
    assert len(got) == len(rows)
    for s, own in by_source(rows).items():
        depth = 0
        for n, kind in own:
            ok = depth < 4 if kind == "push" else depth > 0
            depth += ok if kind == "push" else -ok
            assert got[s, n] == (ok, depth)
    ranks = scan.ranked(scan.segmented(events, "source_id", "seq"), "r", "seq").collect()
    for s, own in by_source(rows).items():
        assert sorted((x["r"], x["seq"]) for x in ranks if x["source_id"] == s) == [(i, n) for i, (n, _) in enumerate(own)]
