import random

from pyspark.sql import functions as F

from cinetable.operators import graph as G
from cinetable.operators.aggregates import suppressed


def test_entities(spark):
    rows = [(" Ada ", "person", "d2", "c1"), ("ADA", "person", "d1", "c2"), ("ada", "ship", None, "c1"), (None, "x", "x", "x"), (" ", "x", "x", "x"), ("Bob", None, None, None)]
    got = {r.name: r for r in G.merged_entities(spark.createDataFrame(rows, "name string, kind string, description string, source_id string")).collect()}
    assert set(got) == {"ADA", "BOB"}
    assert tuple(got["ADA"]) == ("ADA", "person", "d1<SEP>d2", "c1<SEP>c2", 3) and got["BOB"].kind is None
    assert {(r.name, r.chunk_id) for r in G.sources_of(spark.createDataFrame(list(got.values()))).collect()} == {("ADA", "c1"), ("ADA", "c2")}


def test_relations(spark):
    rows = [("a", "b", 1.0), ("b", "a", None), ("b", "c", 2.0), ("c", "c", 1.0), (None, "c", 1.0)]
    merged = G.merged_relations(spark.createDataFrame(rows, "a string, b string, weight double"))
    assert sorted(map(tuple, merged.collect())) == [("a", "b", 2.0, 2), ("b", "c", 2.0, 1)]
    assert {r.name: r.degree for r in G.node_degrees(merged).collect()} == {"a": 1, "b": 2, "c": 1}
    assert {(r.a, r.b): r.degree for r in G.edge_degrees(merged).collect()} == {("a", "b"): 3, ("b", "c"): 3}
    asked = spark.createDataFrame([("b",), ("b",), ("z",)], "name string")
    assert sorted(map(tuple, G.one_hop(asked, merged).collect())) == [("b", "a"), ("b", "c")]
    entities = spark.createDataFrame([("a", "1<SEP>2"), ("b", "2<SEP>3"), ("c", "2")], "name string, source_id string")
    assert sorted(map(tuple, G.chunks_by_relations(asked, entities, merged).collect())) == [("b", "2", 2), ("b", "3", 0)]


def test_evidence_and_budget(spark):
    rows = spark.createDataFrame([("q", 1, 'a "b"', 40), ("q", 2, None, None), ("q", 3, "c", 70), ("q", 4, "d", 1)], "q string, n int, t string, size int")
    assert G.evidence_csv(rows, ["q"], ["n", "t"], [F.col("n")]).first().evidence == 'n,t\n"1","a ""b"""\n"2",""\n"3","c"\n"4","d"'
    assert sorted(r.n for r in G.within_budget(rows, ["q"], ["n"], "size", 100).collect()) == [1, 2]
    assert G.either(rows.where("n < 3"), rows.where("n > 1"), ["n"]).collect() == rows.select("n").orderBy("n").collect()


def test_suppression(spark):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        x, y = rng.randrange(0, 60), rng.randrange(0, 60)
        rows.append((rng.randrange(4), i, rng.choice(["car", "dog", None]), rng.choice([0.1, 0.3, 0.5, 0.5, 0.9]), x, y, x + rng.randrange(0, 40), y + rng.randrange(0, 40)))
    rows.append((9, 900, "car", None, 0, 0, 1, 1))
    df = spark.createDataFrame(rows, "f int, d int, label string, conf double, x1 int, y1 int, x2 int, y2 int")
    df = df.select("f", "d", "label", "conf", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))

    def share(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h
        return w * h / union if union else 0

    want = []
    for f in range(4):
        kept = []
        for r in sorted([r for r in rows if r[0] == f and r[3] and r[3] >= 0.25], key=lambda r: (-r[3], r[1])):
            if not any((k[2] or "") == (r[2] or "") and share(k, r) > 0.4 for k in kept):
                kept.append(r)
        want += [r[1] for r in kept[:20]]
    assert sorted(r.d for r in suppressed(df, ["f"], "d", iou=0.4, limit=20).collect()) == sorted(want)
    assert suppressed(df.limit(0), ["f"], "d").count() == 0
