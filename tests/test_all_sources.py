import duckdb

import __spark_entry__

TYPES = ["click", "view", "purchase", "view"]


def brute(events):
    """Each source's ticks with the latest frame captured up to them."""
    rows = []
    for s in {u for _, u, _ in events}:
        own = [(e, k != "click") for e, u, k in events if u == s]
        kept = [e for (_, before), (e, now) in zip(own, own[1:]) if now and before]
        last = None
        for t in range(max(1, len(events) // 200)):
            frame = max((e for e in kept if e <= 200 * t), default=None)
            rows.append((s, t, 200 * t, frame, frame is not None and frame == last))
            last = frame
    return sorted(rows, key=str)


def test_every_source_is_played(spark, tmp_path):
    """Sources past the twentieth, with gaps between their numbers."""
    events = [(i, (i * i + i // 7) % 31 * 3, TYPES[(i * 13 + i // 5) % 4]) for i in range(1230)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    df = __spark_entry__.queries()["stream_latest_repeat"](spark, str(tmp_path))
    got = sorted((tuple(r) for r in df.select("source_id", "tick", "at", "frame_no", "repeated").collect()), key=str)
    assert got == brute(events) and max(x[0] for x in got) > 20 and any(x[4] for x in got)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(__spark_entry__.oracle_sql()["stream_latest_repeat"]).fetchall(), key=str) == got
