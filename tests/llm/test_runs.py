import json
import random

import pytest

from cinetable.llm.runs import detection_runs, edit_distance, near_text, same_object

SCHEMA = "det_id long, video_id string, frame_ts double, label string, extra string, _chunk int"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert edit_distance(a, b) == plain_distance(a, b)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("The red van.", "THE RED VAM", True),
        ("Question 21 from the audience", "- Questin 21 from the audience", True),
        ("Question 21 from the audience", "Question 22 from the audience", False),
        ("Room 10", "Room 1 0", False),
        ("soirée", "soiree", True),
        ("A small team interrupts the demo", "Our moderator has lost two seats", False),
        ("", " ", True),
        ("gate 4", "", False),
    ],
)
def test_near_text(a, b, same):
    assert near_text(a, b) is same


def test_same_object():
    assert same_object(("1", None), ("1", None)) and not same_object(("1", None), ("2", None))
    assert same_object((None, None), (None, None)) and not same_object((None, "a b c"), (None, None))


def brute(rows):
    def sig(extra):
        try:
            value = json.loads(extra)
        except (TypeError, ValueError):
            return None, None
        if not isinstance(value, dict):
            return None, None
        return (None if value.get("track") is None else str(value["track"])), value.get("text")

    seen, out, now = set(), [], None
    timed = [r for r in rows if r[2] is not None]
    name = lambda r: None if r[3] is None else r[3].strip().lower()
    for r in sorted(timed, key=lambda r: (r[1] is not None, r[1] or "", name(r) is not None, name(r) or "", round(r[2] * 1000), r[0])):
        if r[0] in seen:
            continue
        seen.add(r[0])
        key, ms, s = (r[1], name(r)), round(r[2] * 1000), sig(r[4])
        if now and now[0] == key and ms - now[1] <= 1000 and same_object(now[2], s):
            now[1:3] = [ms, s]
            now[4] = r[0]
            now[5] += 1
        else:
            if now:
                out.append(now)
            now = [key, ms, s, r[0], r[0], 1]
    if now:
        out.append(now)
    return sorted([(k[0], k[1], n, a, b) for k, _, _, a, b, n in out], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_brute_force(many_chunks, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 0.2, 0.2, 0.4, 1.0, 1.1])
        extra = rng.choice(['{"track": 1}', '{"track":"1", "ms": 2}', '{"track": 2}', "{}", "", None, '{"text": "red van"}', '{"text": "red vam"}', '{"text": "red van 2"}', "[1]", "{bad"])
        rows.append((i, rng.choice(["hot"] * 9 + ["b", None]), round(t, 1) if rng.random() < 0.95 else None, rng.choice(["car", " Car", "text", None]), extra, i))
    rows += rows[:60]
    df = many_chunks.createDataFrame(rows, SCHEMA)
    got = detection_runs(df).select("video_id", "label", "run_count", "first_det_id", "last_det_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)
    two = detection_runs(df, min_count=2, whole=False).select("video_id", "label", "run_count", "first_det_id", "last_det_id").collect()
    assert sorted(map(tuple, two), key=repr) == [r for r in brute(rows) if r[2] >= 2]


def test_one_run_over_all_chunks(many_chunks):
    rows = [(i, "v", i * 0.5, "car", '{"track": 1}', 0) for i in range(500)]
    got = detection_runs(many_chunks.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.run_count, r.first_det_id, r.last_det_id, r.first_frame_ts, r.last_frame_ts, r.track) for r in got] == [(500, 0, 499, 0.0, 249.5, "1")]


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, "v", 0.0, "text", json.dumps({"text": "x" * 20_000}), 0), (2, "v", 0.5, "text", json.dumps({"text": "x" * 19_990 + "y" * 10}), 0)], SCHEMA)
    assert detection_runs(df).first().run_count == 2
    assert detection_runs(df.limit(0)).count() == 0
