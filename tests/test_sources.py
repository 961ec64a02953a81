import pytest
from pyspark.sql import functions as F

from cinetable.operators.interval_union import IntervalMap
from cinetable.sinks.store import copy_as, detections_csv, frames_csv, older_detections_csv, register, write_csv, write_json_lines, write_table, write_text_index
from cinetable.sources import files, models
from cinetable.sources.detections import ocr_events, read_chunks_jsonl, read_detections, visual_events
from cinetable.sources.files import session_for_small_files
from cinetable.sources.transcripts import parse_subtitles, read_files, write_subtitles
from cinetable.streaming.ingest import ingest_subtitles
from cinetable.streaming.intervals import running_periods

SRT = """1
00:00:01,000 --> 00:00:03,500
[SPK1] Bonjour, l'été est là

2
00:00:03,500 --> 00:00:07,000
my name is Ada

3
00:00:16,000 --> 00:00:16,000
flash

4
00:00:18,250 --> 00:00:21,000
deux
lignes
"""


def contents(spark, text):
    return spark.createDataFrame([("p", text)], "path string, content string")


def test_strict_and_lenient(spark):
    strict = parse_subtitles(contents(spark, SRT)).orderBy("position").collect()
    assert [(r.utt_id, r.speaker, r.text) for r in strict] == [
        (1, "SPK1", "Bonjour, l'été est là"), (2, "UNK", "my name is Ada"), (3, "UNK", "flash"), (4, "UNK", "deux lignes"),
    ]
    assert (strict[0].start_sec, strict[0].end_sec) == (1.0, 3.5)
    lenient = parse_subtitles(contents(spark, "﻿" + SRT.replace("\n", "\r\n")), lenient=True).orderBy("position").collect()
    assert lenient[0].text == "[SPK1] Bonjour, l'été est là" and len(lenient) == 4


def test_digits_at_the_ends_of_lines_stay(spark):
    text = "7\n00:00:01,000 --> 00:00:02,000\n0 to 100\n1 or 201\n"
    for lenient in (True, False):
        assert parse_subtitles(contents(spark, text), lenient=lenient).first().text == "0 to 100 1 or 201"


def test_dialects_differ(spark):
    text = "1\n00:00:01,000 --> 00:00:02,000\n\n2\n00:00:02,000 --> 00:00:03,000\nx\n\n9\n\nnote\n"
    assert [r.text for r in parse_subtitles(contents(spark, text), lenient=True).collect()] == ["x"]
    assert [r.text for r in parse_subtitles(contents(spark, text)).orderBy("position").collect()] == ["", "x"]
    for lenient in (True, False):
        with pytest.raises(Exception, match="no subtitle time"):
            parse_subtitles(contents(spark, "1\n00:00:01.000 --> 00:00:02,000\nx"), lenient=lenient).collect()
    assert parse_subtitles(contents(spark, None)).count() == 0


def test_subtitle_text_round_trip(spark, tmp_path):
    cues = parse_subtitles(contents(spark, SRT))
    write_subtitles(cues.withColumn("v", F.lit("a")), "v", ["position"], str(tmp_path / "srt"))
    again = parse_subtitles(read_files(spark, str(tmp_path / "srt/v=a/*.txt")))
    columns = ["utt_id", "start_sec", "end_sec", "speaker", "text"]
    assert sorted(map(tuple, again.select(*columns).collect())) == sorted(map(tuple, cues.select(*columns).collect()))


def test_detection_files(spark, tmp_path):
    old, new, bad = (tmp_path / f"{n}.csv" for n in ("old", "new", "bad"))
    old.write_text('frame_ts,label,conf,x1,y1,x2,y2,extra,note\n1.5,TEXT,0.9,1,2,3,4,"{""text"": ""Hi""}",n\n0.5,dog,0.8,1,2,3,4,,\n')
    new.write_text("frame_index,time,time_seconds,label,conf,x1,y1,x2,y2,extra\n3,x,2.5,dog,0.9,1,2,3,4,{}\n")
    bad.write_text("frame_ts,label\n1,dog\n")
    events = visual_events(read_detections(spark, str(old), "v"), ["frame_ts"])
    assert sorted((r.event_id, r.ts, r.is_ocr, r.ocr_text, r.note) for r in events.collect()) == [(1, 0.5, False, None, None), (2, 1.5, True, "Hi", "n")]
    assert [tuple(r) for r in ocr_events(events).collect()] == [(2, "v", 1.5, "Hi")]
    assert read_detections(spark, str(new), "v").first().frame_ts == 2.5
    with pytest.raises(ValueError, match="missing columns"):
        read_detections(spark, str(bad), "v")


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0)], "video_id string, utt_id long, start_sec double")
    write_table(first, root, "utterance", sort=("start_sec",))
    write_table(spark.createDataFrame([("b", 7, 1.0), ("b", 8, 2.0)], first.schema), root, "utterance")
    assert register(spark, root) == ["utterance"]
    assert [tuple(r) for r in spark.sql("select video_id, count(*) from utterance group by 1 order by 1").collect()] == [("a", 1), ("b", 2)]


def test_file_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 1.23456, 'car "x"', 0.123456789, 0.0, 0.0, 1.0, 1.0, "{}")], "det_id long, frame_idx int, frame_ts double, label string, conf double, x1 double, y1 double, x2 double, y2 double, extra string")
    write_csv(detections_csv(df), str(tmp_path / "d"))
    back = read_detections(spark, str(tmp_path / "d"), "v").first()
    assert (back.frame_ts, back.label, back.conf) == (1.235, 'car "x"', 0.123457)
    frame = frames_csv(df).first()
    assert frame.class_counts_json == '{"car \\"x\\"":1}' and frame.n_detections == 1
    write_json_lines(spark.createDataFrame([("c", 0.0, 1.0, None, "e", "t")], "chunk_id string, start_sec double, end_sec double, start_srt string, end_srt string, text string"), str(tmp_path / "c"))
    assert read_chunks_jsonl(spark, str(tmp_path / "c")).first().text == "t"


def test_discovery(spark, tmp_path):
    for name in ("b.MP4", "sub/a.mkv", "x.txt"):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(b"RIFFx")
    found = [r.path.rsplit("/", 1)[1] for r in files.list_videos(spark, str(tmp_path / "in")).collect()]
    assert found == ["b.MP4", "a.mkv"]
    assert all(r.is_wav for r in files.wav_files(spark, str(tmp_path / "in")).collect())
    for name in ("v_1/transcript.srt", "v_2/other.txt", "w_1/transcript.srt", "v_3/meta.json"):
        (tmp_path / "out" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "out" / name).write_text("x")
    assert [r.run for r in files.complete_outputs(spark, str(tmp_path / "out"), "v").collect()] == ["v_1"]
    assert files.latest_index(spark, str(tmp_path / "out")).endswith("v_3")
    urls = spark.createDataFrame([("HTTPS://x",), ("x.mp4",)], "u string")
    assert [r[0] for r in urls.select(files.is_url(F.col("u"))).collect()] == [True, False]


def test_plugged_models(spark):
    frames = spark.createDataFrame([("v", i, i / 2, bytes([i])) for i in range(5)], "video_id string, frame_idx int, ts double, image binary")
    found = models.detect_frames(frames, lambda images, fps: [{"frame": n, "label": f"l{x[0]}", "conf": 1.0, "box": (0, 0, 1, 1)} for n, x in enumerate(images)], fps=2, batch=2)
    assert sorted((r.frame_idx, r.ts, r.label) for r in found.collect()) == [(i, i / 2, f"l{i}") for i in range(5)]
    texts = spark.createDataFrame([("ab",), (None,)], "t string")
    vectors = [r.vector for r in models.encode_texts(texts, "t", lambda xs: [[3.0, 4.0] if x else [0.0, 0.0] for x in xs]).collect()]
    assert vectors[0] == pytest.approx([0.6, 0.8]) and vectors[1] == [0.0, 0.0]
    audio = spark.createDataFrame([("v", b"x")], "video_id string, content binary")
    assert models.recognised(audio, lambda b: [(0.0, 1.0, "hi")]).first().text == "hi"
    turns = models.diarised(audio, lambda b: [(0.0, 1.5, "A")]).first()
    assert (turns.turn_start_ms, turns.turn_end_ms, turns.speaker) == (0, 1500, "A")
    sampled = models.decoded_frames(audio, lambda b: [(i, None if i else 0.1, b"i") for i in range(200)], target_fps=15)
    assert sorted((r.frame_idx, round(r.ts, 3)) for r in sampled.collect())[:3] == [(0, 0.1), (2, 0.067), (4, 0.133)] and sampled.count() == 100
    assert models.described_clips(audio, lambda b, q: f" {q} ", "what").first().description == "what"
    got = {r.s: (r.result, r.error) for r in models.processed(spark.createDataFrame([("a",), ("b",), (None,)], "s string"), "s", lambda s: {"a": "out"}[s]).collect()}
    assert got == {"a": ("out", None), "b": (None, "KeyError: 'b'"), None: (None, "no source")}
    assert models.download_command("https://x/v", "out")[-2:] == ["out/%(id)s.%(ext)s", "https://x/v"]
    assert models.wav_command("a.mp3", "a.wav", "audio") == ["ffmpeg", "-y", "-i", "a.mp3", "a.wav"]


def test_web_results(spark):
    calls = spark.createDataFrame([("q",), ("q",), (None,)], "query string")
    hits = [{"id": "1", "title": "", "url": "u", "text": None}, {"id": "2", "title": "t", "url": "v", "text": " own "}]
    found = models.web_results(calls, lambda q: hits, lambda ids: [{"id": i, "text": f"c{i}"} for i in ids])
    assert sorted(map(tuple, found.collect())) == [("q", "1", "u", "u", "c1"), ("q", "2", "t", "v", "own")]


def test_streaming_ingest(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    (folder / "a.srt").write_text(SRT)
    for extra in (None, "b"):
        if extra:
            (folder / f"{extra}.srt").write_text(SRT)
        ingest_subtitles(spark, str(folder), root, str(tmp_path / "cp")).awaitTermination(120)
    rows = spark.read.parquet(f"{root}/utterance").groupBy("video_id").count().collect()
    assert sorted(map(tuple, rows)) == [("a", 4), ("b", 4)]
    assert read_files(spark, str(folder / "a.srt")).first().content == SRT


def test_streaming_periods(spark, tmp_path):
    source = str(tmp_path / "src")
    schema = "v string, start_ms long, end_ms long"
    batches = [[("a", 0, 5), ("a", 10, 12), ("b", 1, 2)], [("a", 4, 11), ("b", 9, 3), ("b", None, 4)]]
    for n, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        query = (
            running_periods(spark.readStream.schema(schema).parquet(source), "v").writeStream.outputMode("update").trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))).start()
        )
        query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 0, 5), ("a", 0, 12), ("a", 10, 12), ("b", 1, 2)]
    assert list(IntervalMap().periods()) == []


def test_index_alias_and_older_shape(spark, tmp_path):
    said = spark.createDataFrame([("a", 1, "Red van, red"), ("a", 2, None)], "video_id string, utt_id int, text string")
    write_text_index(said, ["video_id", "utt_id"], "text", str(tmp_path), "utterance")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "utterance_fts")).collect())) == [("a", 1, "red", 2), ("a", 1, "van", 1)]
    (tmp_path / "t.srt").write_text(SRT)
    for _ in range(2):
        copy_as(spark, str(tmp_path / "t.srt"), str(tmp_path / "alias.srt"))
    assert (tmp_path / "alias.srt").read_text() == SRT
    df = spark.createDataFrame([(2, 1.0, "dog", 0.5, 0.0, 0.0, 1.0, 1.0, "{}")], "frame_idx int, frame_ts double, label string, conf double, x1 double, y1 double, x2 double, y2 double, extra string")
    write_csv(older_detections_csv(df), str(tmp_path / "old"))
    assert read_detections(spark, str(tmp_path / "old"), "v").first().frame_ts == 1.0


def test_no_local_folder_on_a_cluster(monkeypatch):
    from unittest.mock import MagicMock

    from cinetable.plans.lineage import ensure_checkpoint_dir

    cluster = MagicMock()
    cluster.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    cluster.conf.get.return_value = None
    for master in ("yarn", "spark://x:1", "local-cluster[1,1,1]"):
        cluster.sparkContext.master = master
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(cluster)


@pytest.fixture
def many_folders(spark, tmp_path):
    """A folder each for 100 files, of which Spark by itself gives a task one."""
    for n in range(100):
        (tmp_path / f"in/video_id={n}").mkdir(parents=True)
        (tmp_path / f"in/video_id={n}/{n}.srt").write_text(SRT)
    settings = {"spark.sql.files.maxPartitionBytes": "4m", "spark.sql.shuffle.partitions": "5"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield str(tmp_path / "in")
    for key, value in before.items():
        spark.conf.set(key, value)


def most_tasks(spark, group):
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds]
    return max(tracker.getStageInfo(s).numTasks for s in stages if tracker.getStageInfo(s))


def test_many_files_few_tasks(spark, many_folders):
    listing = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None)
    spark.sparkContext.setJobGroup("many files", "")
    try:
        found = parse_subtitles(read_files(spark, many_folders))
        assert found.count() == 400 and found.select("path").distinct().count() == 100
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert most_tasks(spark, "many files") <= 16
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism", None) == listing


def test_stream_of_many_files_few_tasks(spark, many_folders, tmp_path):
    own = session_for_small_files(spark)
    assert own.conf.get("spark.sql.shuffle.partitions") == "5" and own.conf.get("spark.sql.files.maxPartitionBytes") == "4m"
    stream = ingest_subtitles(own, many_folders, str(tmp_path / "store"), str(tmp_path / "cp"))
    stream.awaitTermination()
    assert most_tasks(spark, str(stream.runId)) <= 16
    assert spark.read.parquet(str(tmp_path / "store/utterance")).count() == 400
