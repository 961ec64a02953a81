import random

import pytest

from cinetable.llm import nearest
from cinetable.llm.nearest import events_near_speech, media_key, nearest_interval

EVENTS = "event int, entity string, at_ms long, s int"
INTERVALS = "entity string, entity_name string, s long, e long, interval long, level int"


def brute(events, intervals, within):
    out = set()
    for event, entity, at, _ in events:
        best = None
        for key, name, s, e, i, _ in intervals:
            if entity is None or at is None or s is None or e is None or key != entity or s >= e:
                continue
            d = max(s - at, at - e, 0)
            if d <= within and (best is None or (d, -s, i) < best[:3]):
                best = (d, -s, i, name)
        if best:
            out.add((event, best[3], best[2], best[0]))
    return sorted(out)


@pytest.mark.parametrize("dense", [512, 3])
@pytest.mark.parametrize(("seed", "tick", "long"), [(0, 2500, 0), (1, 7, 0), (2, 10, 5000), (3, 1, 300), (4, 100_000, 0), (5, 3, 40_000), (6, 4096, 9)])
def test_equals_brute_force(spark, monkeypatch, seed, tick, long, dense):
    monkeypatch.setattr(nearest, "DENSE", dense)
    rng = random.Random(seed)
    intervals = []
    for i in range(120):
        s = rng.randrange(0, 3000)
        length = rng.choice([0, 1, 5, 30, -4] + [long] * bool(long))
        key = rng.choice(["hot", "hot", "b", None])
        intervals.append((key, None if key is None else key.upper(), s if rng.random() < 0.97 else None, s + length, rng.randrange(60), 0))
    events = [(i, rng.choice(["hot", "hot", "b", "c", None]), rng.randrange(-50, 3200) if rng.random() < 0.95 else None, 0) for i in range(300)]
    got = nearest_interval(spark.createDataFrame(events + events[:50], EVENTS), spark.createDataFrame(intervals + intervals[:20], INTERVALS), within_ms=20, tick_ms=tick)
    assert sorted(map(tuple, got.collect())) == brute(events, intervals, 20)


def test_ties(spark):
    intervals = [("v", "v", 0, 10, 5, 0), ("v", "v", 4, 10, 9, 0), ("v", "v", 4, 12, 7, 0), ("v", "v", 30, 40, 1, 0), ("v", "v", 30, 50, 0, 0)]
    events = [(1, "v", 6, 0), (2, "v", 20, 0), (3, "v", 21, 0)]
    got = nearest_interval(spark.createDataFrame(events, EVENTS), spark.createDataFrame(intervals, INTERVALS), within_ms=9, tick_ms=4)
    assert sorted((r.event, r.interval, r.distance_ms) for r in got.collect()) == [(1, 7, 0), (2, 7, 8), (3, 0, 9)]


def test_extremely_long_interval(spark):
    df = spark.createDataFrame([("v", "v", 0, 10**15, 1, 0), ("v", "v", 10**14, 10**14 + 5, 2, 0)], INTERVALS)
    events = spark.createDataFrame([(1, "v", 5 * 10**14, 0), (2, "v", 10**14 + 1, 0)], EVENTS)
    assert sorted((r.event, r.interval) for r in nearest_interval(events, df).collect()) == [(1, 1), (2, 2)]


def test_spellings_of_video_ids(spark):
    names = [" lobby_000000", "LOBBY_000000.MP4", "lobby-000000", "Lobby 000000.mkv", "lobby_000000"]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    assert {r[0] for r in df.select(media_key(df.v)).collect()} == {"lobby_000000"}
    ocr = spark.createDataFrame([(i, n, 1.0) for i, n in enumerate(names)] + [(9, "lobby_000000", None)], "event_id int, video_id string, ts double")
    utt = spark.createDataFrame([("lobby_000000", 4, 2.0, 3.0), ("lobby_000000", 5, 1.0, float("nan"))], "video_id string, utt_id int, start_sec double, end_sec double")
    got = sorted(map(tuple, events_near_speech(ocr, utt).collect()))
    assert got == [(i, "lobby_000000", 4, 1000) for i in range(5)]
    assert events_near_speech(ocr.limit(0), utt).count() == 0 and events_near_speech(ocr, utt.limit(0)).count() == 0


def test_a_dense_tick(spark):
    """100,000 intervals of one entity in one tick, as many moments as it has: candidates stay few."""
    import bisect

    rng = random.Random(11)
    data = [("v", "V", s := rng.randrange(4096, 8190), min(8191, s + rng.randrange(1, 900)), i, 0) for i in range(100_000)]
    moments = range(4096, 8192, 3)
    events = [(t, "v", t, 0) for t in moments]
    got = {r.event: (r.interval, r.distance_ms) for r in nearest_interval(spark.createDataFrame(events, EVENTS), spark.createDataFrame(data, INTERVALS)).collect()}
    data.sort(key=lambda d: (d[2], -d[4]))
    starts = [d[2] for d in data]
    for t in moments:
        best = None
        for d in reversed(data[: bisect.bisect_right(starts, t)]):
            if d[3] >= t:
                best = (d[4], 0)
                break
        assert best is None or got[t] == best
    assert len(got) == len(moments)
