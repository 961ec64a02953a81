import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinetable.functions.text import token_set_ratio
from cinetable.operators import retrieval as R
from cinetable.operators.aggregates import by_frame
from cinetable.operators.islands import text_segments, with_islands
from cinetable.operators.joins import points_in_intervals, points_with_intervals, speakers_by_overlap, with_contents, with_neighbours
from cinetable.operators.positions import with_position
from cinetable.operators.windows import atempo_steps, frame_times, history_text, rescaled, time_windows, trimmed_history


@pytest.fixture()
def many_chunks(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=repr)


def test_interval_join(spark):
    said = spark.createDataFrame([("v", 10.0, 12.0, 1), ("v", 30.0, 31.0, 2), ("v", 5.0, 5000.0, 3), ("v", None, 3.0, 4)], "v string, s double, e double, u int")
    seen = spark.createDataFrame([(1, "v", 4.9), (2, "v", 5.0), (3, "v", 17.0), (4, "v", 17.1), (5, "v", 36.0), (6, "w", 10.0), (7, "v", None), (8, None, 10.0)], "id int, v string, t double")
    near = points_with_intervals(seen, said, ["v"], ["id"], F.col("t"), F.col("s") - 5, F.col("e") + 5, bucket=4.0)
    want = [(i, u) for i, v, t in rows(seen, "id", "v", "t") for u, s, e in [(1, 10, 12), (2, 30, 31), (3, 5, 5000)] if v == "v" and t is not None and s - 5 <= t <= e + 5]
    alone = [(i, None) for i in range(1, 9) if i not in {w[0] for w in want}]
    assert rows(near, "id", "u") == sorted(want + alone, key=repr)


def test_interval_join_random(spark):
    rng = random.Random(3)
    ivs = [(rng.choice("ab"), s := rng.randrange(1000), s + rng.choice([0, 3, 40, 700]), i) for i in range(80)]
    pts = [(rng.choice("ab"), rng.randrange(1200), i) for i in range(120)]
    got = points_in_intervals(
        spark.createDataFrame(pts, "k string, t long, p int"), spark.createDataFrame(ivs, "k string, s long, e long, i int"), ["k"], F.col("t"), F.col("s"), F.col("e"), bucket=8
    )
    assert rows(got, "p", "i") == sorted([(p, i) for k, t, p in pts for j, s, e, i in ivs if k == j and s <= t <= e], key=repr)


def test_speakers(spark):
    segments = spark.createDataFrame([("v", 1, 0, 10), ("v", 2, 20, 21), ("v", 3, 100, 110), ("v", 4, None, 5)], "v string, seg int, start_ms long, end_ms long")
    turns = spark.createDataFrame(
        [("v", 0, 4, "A"), ("v", 4, 7, "B"), ("v", 7, 8, "A"), ("v", 100, 105, "Z"), ("v", 105, 110, "C")], "v string, turn_start_ms long, turn_end_ms long, speaker string"
    )
    got = speakers_by_overlap(segments, turns, ["v"], "seg", bucket=3)
    assert rows(got, "seg", "speaker", "overlap_ms") == [(1, "A", 5), (2, "UNK", 0), (3, "Z", 5), (4, "UNK", 0)]


def test_windows(spark):
    entries = [("v", 1, 1000, 3500, "a"), ("v", 2, 3500, 7000, "b"), ("v", 3, 16000, 16000, "c"), ("v", 4, 18250, 21000, "d"), ("v", 5, None, 3, "x"), ("w", 1, 5, 9, None)]
    df = spark.createDataFrame(entries, "v string, o int, start_ms long, end_ms long, text string")
    got = rows(time_windows(df, ["v"], "o"), "v", "chunk_id", "text", "end_ms")
    assert got == [
        ("v", "win_000000_0000001000", "a b", 6000),
        ("v", "win_000001_0000006000", "b", 11000),
        ("v", "win_000003_0000016000", "d", 21000),
        ("w", "win_000000_0000000005", "", 9),
    ]
    assert time_windows(df.limit(0), ["v"], "o").count() == 0


def test_windows_equal_a_loop(spark):
    rng = random.Random(1)
    entries = [("v", i, s := rng.randrange(0, 60_000, 250), s + rng.choice([0, 250, 2000, 9000]), f"t{i}") for i in range(60)]
    anchor, top = entries[0][2], max(e[3] for e in entries)
    want, n = [], 0
    while anchor + n * 5000 <= top:
        t0, t1 = anchor + n * 5000, min(anchor + n * 5000 + 5000, top)
        said = [e[4] for e in entries if e[3] > t0 and e[2] < t1]
        if said:
            want.append((n, " ".join(said)))
        n += 1
    df = spark.createDataFrame(entries, "v string, o int, start_ms long, end_ms long, text string")
    assert rows(time_windows(df, ["v"], "o"), "window_no", "text") == sorted(want, key=repr)


def test_positions(many_chunks):
    data = [("hot", i % 50, i) for i in range(200)] + [(None, 1, 900), ("b", 3, 901)]
    got = with_position(many_chunks.createDataFrame(data, "k string, t int, id int"), ["k"], ["t", "id"])
    want = []
    for key in ("hot", None, "b"):
        want += [(key, t, i, n) for n, (k, t, i) in enumerate(sorted([d for d in data if d[0] == key], key=lambda d: d[1:]))]
    assert rows(got, "k", "t", "id", "position") == sorted(want, key=repr)
    assert with_position(got.limit(0), [], ["t"]).count() == 0


def test_neighbours(spark):
    chunks = spark.createDataFrame([("v", i, f"c{i}") for i in range(5)], "v string, position int, name string")
    got = with_neighbours(chunks.where("position = 1").select("v", "position"), chunks, ["v"], before=3, after=2)
    assert rows(got, "offset", "neighbour.name") == [(-1, "c0"), (0, "c1"), (1, "c2"), (2, "c3")]


def test_history(spark):
    df = spark.createDataFrame([("c", i, "user", " " + "x" * 40) for i in range(3)] + [("d", 1, None, None)], "c string, p int, role string, content string")
    assert [len(r.content) for r in trimmed_history(df, ["c"], "p", max_chars=100).where("c = 'c'").orderBy("p").collect()] == [40, 40, 20]
    assert rows(trimmed_history(df, ["c"], "p", max_chars=80), "c", "p") == [("c", 0), ("c", 1), ("d", 1)]
    texts = {r.c: r.history for r in history_text(df, ["c"], "p", max_chars=90).collect()}
    assert texts == {"c": "\n".join(["User: " + "x" * 40] * 2), "d": "User: "}
    assert rows(trimmed_history(df, ["c"], "p", max_messages=1), "c", "p") == [("c", 2), ("d", 1)]


def test_frames(spark):
    data = [("v", 3, i, 0.1, l, c, "{}") for i, (l, c) in enumerate([("person", 0.9), ("car", 0.8), ("person", 0.95)])]
    df = spark.createDataFrame(data, "v string, frame_idx int, det_id int, frame_ts double, label string, conf double, extra string")
    for c in ("x1", "y1", "x2", "y2"):
        df = df.withColumn(c, F.lit(0.0))
    got = by_frame(df, ["v"]).first()
    assert (got.labels, got.n_detections, got.class_counts) == ("car;person;person", 3, {"car": 1, "person": 2})
    assert [o[1] for o in got.objects] == [0.8, 0.95, 0.9]


def test_frame_times(spark):
    frames = spark.range(0, 300).select(F.col("id").cast("int").alias("frame_idx"), F.lit(None).cast("double").alias("pts_seconds"))
    own = {r.sample_no: r.ts for r in frame_times(frames, target_fps=7, native_fps=30).collect()}
    old = {r.sample_no: r.ts for r in frame_times(frames, target_fps=7, native_fps=30, batch=64).collect()}
    assert own[63] == pytest.approx(8.4) and own[64] == pytest.approx(8.533, abs=1e-3)
    assert old[63] == pytest.approx(9.0) and old[64] == pytest.approx(8.533, abs=1e-3)
    assert np.prod(atempo_steps(5.0)) == pytest.approx(5.0) and all(0.5 <= s <= 2 for s in atempo_steps(0.1))
    df = spark.createDataFrame([(2.0,)], "t double")
    assert rescaled(df, ["t"], 1.0005).first().t == 2.0 and rescaled(df, ["t"], 2.0).first().t == 4.0


def sequential_segments(data, gap, similarity):
    out, now = [], None
    for v, i, ts, text, conf in sorted(data, key=lambda d: (d[0], d[2], d[1])):
        if now and now[0] == v and round(ts * 1000) - round(now[3] * 1000) <= gap and token_set_ratio(text, now[1]) >= similarity:
            now[3] = ts
            now[4].append(conf)
        else:
            if now:
                out.append(now)
            now = [v, text, ts, ts, [conf]]
    if now:
        out.append(now)
    return sorted([(v, t, a, b, len(c)) for v, t, a, b, c in out], key=repr)


def test_segments_equal_the_loop(many_chunks):
    small = [(0.0, "a"), (0.5, "a"), (1.5, "a"), (2.6, "a"), (2.7, "b"), (2.7, "a")]
    data = [("v", i, t, x, 0.9) for i, (t, x) in enumerate(small)]
    rng = random.Random(5)
    t = 100.0
    for i in range(300):
        t += rng.choice([0.2, 0.2, 0.2, 0.9, 1.3])
        data.append(("w", 100 + i, round(t, 1), rng.choice(["red van", "the red van", "blue sky", "red van x y z"]), 0.5))
    data += [("x", 500 + i, 7 + i / 10, "one text for long", 0.5) for i in range(200)]
    df = many_chunks.createDataFrame(data, "video_id string, det_id long, frame_ts double, text string, conf double")
    df = df.withColumn("bbox", F.array(F.col("det_id").cast("double"), F.lit(1.0)))
    got = text_segments(df)
    assert sum(len(r.bboxes) for r in got.collect()) == len(data) and all(len(r.bboxes) == r.frames for r in got.collect())
    long = got.where("video_id = 'x'").first()
    assert [b[0] for b in long.bboxes] == [float(i) for i in range(500, 700)] and long.avg_conf == 0.5
    assert rows(got, "video_id", "text", "start_sec", "end_sec", "frames") == sequential_segments(data, 1000, 90)
    assert text_segments(df.limit(0)).count() == 0


def test_islands(many_chunks):
    rng = random.Random(2)
    data, t = [], 0
    for i in range(250):
        t += rng.choice([100, 100, 100, 100, 5000]) if i % 120 else 90_000
        data.append(("hot" if i < 230 else "b", i, t))
    got = with_islands(many_chunks.createDataFrame(data, "k string, id int, ms long"), ["k"], "ms", "id", gap_ms=1000)
    groups, last = {}, None
    for k, i, ms in data:
        if last is None or last[0] != k or ms - last[1] > 1000:
            island = i
        groups.setdefault(island, set()).add(i)
        last = (k, ms)
    seen = {}
    for r in got.collect():
        seen.setdefault(r.island, set()).add(r.id)
    assert sorted(map(sorted, seen.values())) == sorted(map(sorted, groups.values()))


def test_contents(spark):
    found = spark.createDataFrame([(1, "", "u", None), (2, "t", None, " own "), (3, None, None, "")], "id int, title string, url string, text string")
    other = spark.createDataFrame([(1, "x" * 900), (2, "other")], "id int, text string")
    got = {r.id: r for r in with_contents(found, other).collect()}
    assert got[1].title == "u" and got[1].snippet == "x" * 790 + "…"
    assert got[2].snippet == "own" and (got[3].title, got[3].snippet) == ("(untitled)", "")


DOCS = ["red van gate", "blue sky", "red red sky", "nothing here", "gate gate gate", None]


def okapi(query):
    docs = [(d or "").split() for d in DOCS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = {w: sum(w in d for d in docs) for d in docs for w in d}
    raw = {w: np.log(n - c + 0.5) - np.log(c + 0.5) for w, c in df.items()}
    floor = 0.25 * np.mean(list(raw.values()))
    idf = {w: v if v >= 0 else floor for w, v in raw.items()}
    scores = [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.split()) for d in docs]
    return sorted(enumerate(scores), key=lambda x: (-x[1], x[0]))


def test_bm25(spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "index long, text string")
    index = R.build_lexical(docs, "index", "text")
    index.write(str(tmp_path / "ix"))
    queries = ["red gate gate", "sky", "unknown"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    for lexical in (index, R.LexicalIndex.read(spark, str(tmp_path / "ix"))):
        got = {}
        for r in R.bm25_top(lexical, asked, 4).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r["index"], r.score))
        for n, query in enumerate(queries):
            want = okapi(query)[:4]
            assert [i for i, _ in got[n]] == [i for i, _ in want]
            assert np.allclose([s for _, s in got[n]], [s for _, s in want])


def test_dense(spark):
    rng = np.random.default_rng(0)
    data = rng.standard_normal((60, 8))
    data[7] = data[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)] + [(90, None), (91, [1.0])], "index long, vector array<double>")
    asked = spark.createDataFrame([(5, data[3].tolist()), (6, data[20].tolist())], "query long, vector array<double>")
    got = {}
    for r in R.dense_top(df.repartition(3), asked, 5).orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r["index"])
    for q, v in ((5, data[3]), (6, data[20])):
        assert got[q] == sorted(range(60), key=lambda i: (-round(float(data[i] @ v), 12), i))[:5]


def ranked(spark, triples):
    return spark.createDataFrame(triples, "query long, index long, score double, rank int")


def test_fusion(spark):
    a, b = ranked(spark, [(1, 7, 4.0, 1), (1, 3, 2.0, 2)]), ranked(spark, [(1, 3, 0.8, 1), (1, 9, 0.5, 2)])
    got = [(r["index"], round(r.score, 6)) for r in R.fuse_ranks(a, b, 5).orderBy("rank").collect()]
    assert got == [(3, 0.032522), (7, 0.016493), (9, 0.016228)]
    got = [(r["index"], round(r.score, 6)) for r in R.fuse_scores(a, b, 5).orderBy("rank").collect()]
    assert got == [(7, 0.612372), (3, 0.555584), (9, 0.101015)]


def test_mmr(spark):
    docs, query = np.array([[1, 0], [0.96, 0.28], [0.6, 0.8], [0, 1]]), np.array([1.0, 0.0])
    assert R.mmr_order(query, docs, 3, 0.7) == [0, 1, 2]
    assert R.mmr_order(query, docs, 3, 0.3) == [0, 3, 2]
    assert R.mmr_order(query, docs, 4) == [0, 1, 2, 3]
    hits = spark.createDataFrame([(1, [1.0, 0.0], i, v.tolist(), i + 1) for i, v in enumerate(docs)], "query long, query_vector array<double>, index long, vector array<double>, rank int")
    assert [r["index"] for r in R.rerank_mmr(hits, 3, weight=0.3).orderBy("rank").collect()] == [0, 3, 2]


def test_search_and_context(spark):
    chunks = spark.createDataFrame([(i, f"00:00:0{i},000", f"00:00:0{i},500", t) for i, t in enumerate(DOCS)], "index long, start_srt string, end_srt string, text string")
    lexical = R.build_lexical(chunks, "index", "text")
    asked = spark.createDataFrame([(1, "gate", [1.0, 0.0])], "query_id long, text string, vector array<double>")
    vectors = spark.createDataFrame([(i, [float(i == 4), 1.0]) for i in range(5)], "index long, vector array<double>")
    for method in ("bm25", "embed", "rrf", "weighted"):
        hits = R.search(chunks, lexical, asked, vectors, method=method, k=2)
        assert hits.where("rank = 1").first()["index"] == 4 and hits.count() == 2
    crossed = R.search(chunks, lexical, asked, vectors, rerank="cross", k=1, scorer=lambda q, t: [float((x or "") == "blue sky") for x in t])
    assert crossed.first()["index"] == 1 and crossed.first().method == "hybrid-rrf+cross"
    assert R.search(chunks, lexical, asked, vectors, rerank="mmr", k=2).count() == 2
    hits = R.search(chunks, lexical, asked, method="bm25", k=1)
    text = R.context_text(R.passages(hits, chunks, before=1, after=0)).first().context
    assert text == "### Passage 1 | Main: 00:00:04,000–00:00:04,500\n[00:00:04,000–00:00:04,500] gate gate gate\n[00:00:03,000–00:00:03,500] nothing here"
    assert R.timecodes(hits).first().start == 4


def test_search_with_a_missing_text_or_vector(spark):
    chunks = spark.createDataFrame([(i, "ab", t) for i, t in enumerate(["blue sky", "red car", "green tree"])], "index long, start_srt string, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.6, 0.8])], "index long, vector array<double>")
    asked = spark.createDataFrame([(1, "red car", None), (2, None, [1.0, 0.0]), (3, "tree", [0.0, 1.0])], "query_id long, text string, vector array<double>")
    lexical = R.build_lexical(chunks, "index", "text")
    got = {(r.query, r["rank"]): (r["index"], r.score) for r in R.search(chunks, lexical, asked, vectors, k=3).collect()}
    order = {1: [1, 0, 2], 2: [0, 2, 1]}  # of the only list
    for q, places in order.items():
        for rank, index in enumerate(places, 1):
            assert got[q, rank] == (index, pytest.approx(1 / (60 + rank) + 1 / 10_060))
    assert len(got) == 9


def test_hybrid_query_keeps_texts_without_vectors(spark, monkeypatch):
    from cinetable.queries import search

    chunks = spark.createDataFrame([(0, "red car"), (1, "blue sky")], "index long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "index long, vector array<double>")
    monkeypatch.setattr(search, "_chunks", lambda *_: chunks)
    monkeypatch.setattr(search, "_vectors", lambda *_: vectors)
    monkeypatch.setattr(search, "_text_queries", lambda *_: spark.createDataFrame([(50, "red"), (100, "sky")], "query_id long, text string"))
    monkeypatch.setattr(search, "_vector_queries", lambda *_: spark.createDataFrame([(0, [1.0, 0.0]), (150, [0.0, 1.0])], "query long, vector array<double>"))
    assert {r.query for r in search.search_hybrid(spark, "").collect()} == {0, 50, 150}


def test_questions_in_several_passes(spark, monkeypatch):
    rng = random.Random(12)
    words = ["red", "van", "gate", "sky", "tree", "car"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, weights=[30] * 3 + [5] * 3 + [1] * 60, k=rng.randrange(0, 30)))) for i in range(700)]
    asked = [(q, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for q in range(600)]
    index = R.build_lexical(spark.createDataFrame(docs, "index long, text string").repartition(3), "index", "text")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = {}
    for r in R.bm25_scores(index, queries).collect():
        want.setdefault(r.query, {})[r["index"]] = r.score
    for limit in (64 << 20, 20_000):
        monkeypatch.setattr(R, "SENT_BYTES", limit)
        got = {}
        for r in R.bm25_top(index, queries, 7).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append((r["index"], r.score))
        for q, _ in asked:
            scores = {i: 0.0 for i in range(700)} | want.get(q, {})
            best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:7]
            assert np.allclose([s for _, s in got[q]], [s for _, s in best])
            assert {i for i, s in got[q] if s > best[-1][1] + 1e-9} == {i for i, s in best if s > best[-1][1] + 1e-9}


def test_stored_index(spark, tmp_path):
    chunks = spark.createDataFrame([(0, "a", "red van"), (1, "b", None)], "index long, chunk_id string, text string")
    index = R.build_lexical(chunks, "index", "text")
    index.chunks, index.vectors, index.meta = chunks, spark.createDataFrame([(0, [1.0])], "index long, vector array<float>"), {"anchor": "first"}
    index.write(str(tmp_path / "ix"))
    again = R.LexicalIndex.read(spark, str(tmp_path / "ix"), chunks=chunks.schema, vectors=True)
    assert (again.avgdl, again.meta) == (1.0, {"anchor": "first"})
    assert sorted(map(tuple, again.chunks.collect())) == sorted(map(tuple, chunks.collect())) and again.vectors.count() == 1
    assert {(r.term, r.tf) for r in again.postings.collect()} == {("red", 1), ("van", 1)}
