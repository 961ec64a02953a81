import random

import pytest

from cinetable.operators.interval_union import IntervalMap, continuous_periods

SCHEMA = "v string, start_sec double, end_sec double"


def brute(rows, max_gap):
    by = {}
    for v, s, e in rows:
        if s is None or e is None or s != s or e != e:
            continue
        s, e = round(s * 1000), round(e * 1000)
        if e > s:
            by.setdefault(v, []).append((s, e))
    out = []
    for v, parts in by.items():
        merged = []
        for s, e in sorted(parts):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(e, merged[-1][1])
            else:
                merged.append([s, e])
        out += [(v, "period", s, e) for s, e in merged]
        out += [(v, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if max_gap is None or b[0] - a[1] <= max_gap]
    return sorted(out, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("v", "kind", "start_ms", "end_ms").collect()], key=repr)


@pytest.fixture()
def many_chunks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_over_many_chunks(many_chunks, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        # one entity holds most rows; some intervals cover many chunks
        v = rng.choice(["hot"] * 6 + ["b", "c", None])
        s = rng.randrange(0, 4000)
        length = rng.choice([0, 1, 2, 5, -3, 900]) if rng.random() < 0.9 else None
        rows.append((v, s / 10 if rng.random() < 0.97 else None, None if length is None else (s + length) / 10))
    rows += rows[:40]
    df = many_chunks.createDataFrame(rows, SCHEMA)
    for max_gap in (None, 300):
        assert got(continuous_periods(df, ["v"], "start_sec", "end_sec", max_gap_ms=max_gap)) == brute(rows, max_gap)


def test_touching_nested_and_unusable(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 2.0), ("a", 0.2, 0.4), ("a", 5.0, 5.0), ("a", 9.0, 8.0), ("a", float("nan"), 3.0), ("a", 4.0, 4.5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(continuous_periods(df, ["v"], "start_sec", "end_sec")) == sorted(
        [("a", "period", 0, 2000), ("a", "gap", 2000, 4000), ("a", "period", 4000, 4500)], key=repr
    )


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert continuous_periods(empty, ["v"], "start_sec", "end_sec").count() == 0
    df = spark.createDataFrame([("a", 0.0, 1.0, 7, 8)], "v string, start_sec double, end_sec double, _chunk_ int, kind int")
    out = continuous_periods(df, ["v"], "start_sec", "end_sec")
    assert out.columns == ["v", "kind", "start_ms", "end_ms"] and out.count() == 1


def test_milliseconds_input(spark):
    df = spark.createDataFrame([(1, 10, 20), (1, 15, 30)], "v int, a long, b long")
    assert [tuple(r) for r in continuous_periods(df, ["v"], "a", "b", seconds=False).collect()] == [(1, "period", 10, 30)]


def test_map_inserts_anywhere():
    m = IntervalMap()
    for s, e in [(10, 20), (0, 5), (30, 40), (5, 10), (19, 31)]:
        m.insert(s, e)
    assert list(m.periods()) == [(0, 40, None)]
