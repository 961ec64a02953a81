import pytest

from cinetable.sources.detections import read_detections_with_faults
from cinetable.sources.faulty import Fault, assemble_lines, is_json_object, parse_cue, parse_detection, parse_records

GOOD = '1.5,dog,0.5,1,2,3,4,"{""track"": 1}"'


def reason(parse, raw):
    try:
        parse(raw)
    except Fault as fault:
        return fault.args[0]
    return None


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (GOOD, None),
        (GOOD + "\r\n\n", None),
        (" 1.5 ,dog, 0.5 ,1,2,3,4,", None),
        ('1,"a ""b"", c",0.5,1,2,3,4,{}', None),
        ('1,"two\nlines",0.5,1,2,3,4,', None),
        ('1,say "hi",0.5,1,2,3,4,', None),
        ("", "columns"),
        (None, "columns"),
        (",,,", "columns"),
        ("1,dog,0.5,1,2,3,4", "columns"),
        ("1,dog,0.5,1,2,3,4,,", "columns"),
        ("1,dog\n,0.5,1,2,3,4,", "columns"),
        ('1,"dog,0.5,1,2,3,4,', "quoting"),
        ('1,"dog" x,0.5,1,2,3,4,', "quoting"),
        ('1,"dog', "quoting"),
        ("frame_ts,label,conf,x1,y1,x2,y2,extra", "value"),
        ("-0.1,dog,0.5,1,2,3,4,", "value"),
        ("1e3,dog,0.5,1,2,3,4,", "value"),
        ("NaN,dog,0.5,1,2,3,4,", "value"),
        ("１,dog,0.5,1,2,3,4,", "value"),
        ("1,dog,1.01,1,2,3,4,", "value"),
        ("1,dog,0.5,3,2,1,4,", "value"),
        ("1,  ,0.5,1,2,3,4,", "value"),
        ("1,dog,0.5,1,2,3,4,[]", "value"),
        ('1,dog,0.5,1,2,3,4,"{""a"": NaN}"', "value"),
        ("1,dog,0.5,1,2,3,4,   ", None),
    ],
)
def test_detection_lines(raw, want):
    assert reason(parse_detection, raw) == want


TIMES = "00:00:01,000 --> 00:00:02,000"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (f"1\n{TIMES}\nhi", None),
        (f"﻿ 007 \r\n{TIMES}\r\nhi\r\n\r\n", None),
        (f"{TIMES}\n[SPK1] hi", None),
        ("00:00:01,000-->00:00:01,000\nhi", None),
        (f"1\n{TIMES}\n1 --> 2", None),
        ("", "columns"),
        (None, "columns"),
        ("1", "columns"),
        (f"1\n{TIMES}", "columns"),
        (f"1\n{TIMES}\n  \n", "columns"),
        (f"1.\n{TIMES}\nhi", "columns"),
        ("WEBVTT", "columns"),
        (f"1\n{TIMES}\n [SPK1 hi", "quoting"),
        (f"1\n{TIMES} --> 00:00:03,000\nhi", "value"),
        ("1\n00:00:01.000 --> 00:00:02,000\nhi", "value"),
        ("1\n00:61:01,000 --> 00:62:02,000\nhi", "value"),
        ("1\n00:00:03,000 --> 00:00:02,000\nhi", "value"),
        (f"1\n{TIMES}\nh\x07i", "value"),
        (f"1\n{TIMES}\nh�i", "value"),
    ],
)
def test_subtitle_blocks(raw, want):
    assert reason(parse_cue, raw) == want


def test_typed_fields():
    assert parse_detection(GOOD) == (1.5, "dog", 0.5, 1.0, 2.0, 3.0, 4.0, '{"track": 1}')
    assert parse_cue(f"7\n{TIMES}\n[SPK1] a\nb") == (7, 1000, 2000, "SPK1", "a b")


def test_json_standard():
    assert is_json_object('{"a": 1e400, "b": "\\ud800"}') and is_json_object("{" + '"n": ' + "1" * 5000 + "}")
    assert not any(map(is_json_object, ["{'a': 1}", '{"a": 1,}', '{"a": Infinity}', "7", "null", "{} {}", "[" * 100_000]))


def test_rows_and_reasons(spark):
    df = spark.createDataFrame([(1, GOOD, "x"), (2, "a,b", None), (3, None, "y"), (1, GOOD, "x")], "id long, raw string, reason_ string")
    out = {(r.id, r.label, r.raw_record, r.reason) for r in parse_records(df, "detection", keep=["id"]).collect()}
    assert out == {(1, "dog", None, None), (2, None, "a,b", "columns"), (3, None, None, "columns")}
    assert parse_records(df, "detection", keep=["id"]).count() == 4
    assert parse_records(df.limit(0), "cue", keep=["id"]).count() == 0
    with pytest.raises(ValueError):
        parse_records(df.withColumnRenamed("reason_", "reason"), "cue", keep=["reason"])


def test_very_long_record(spark):
    raw = "1,dog,0.5,1,2,3,4," + '"{""t"": ""' + "x" * 1_000_000 + '""}"'
    df = spark.createDataFrame([(raw,)], "raw string")
    assert parse_records(df, "detection").where("reason is null").count() == 1


def test_records_of_a_file(spark, tmp_path):
    assert list(assemble_lines(iter(['a,"b\n', 'c"\n', "d\n"]))) == ['a,"b\nc"\n', "d\n"]
    path = tmp_path / "d.csv"
    path.write_text('frame_ts,label,conf,x1,y1,x2,y2,extra\n1,"two\nlines",0.5,1,2,3,4,\n1,dog\n2,cat,0.5,1,2,3,4,{}\n')
    rows = read_detections_with_faults(spark, str(path)).orderBy("record_no").collect()
    assert [(r.label, r.reason) for r in rows] == [("two\nlines", None), (None, "columns"), ("cat", None)]


@pytest.mark.parametrize(
    ("line", "want"),
    [("0" * 19 + "1", 1), ("-" + "0" * 5000 + "7", -7), (str(2**63 - 1), 2**63 - 1), (str(-(2**63)), -(2**63)), (str(2**63), None), ("9" * 5000, None), ("+" + "0" * 30, 0)],
)
def test_long_cue_numbers(line, want):
    assert parse_cue(f"{line}\n{TIMES}\na")[0] == want


def test_an_open_quote_costs_one_record(spark, tmp_path):
    rows = [f"{n},dog,0.5,1,2,3,4,{{}}" for n in range(40)]
    rows[3] = '3,"dog,0.5,1,2,3,4,{}'
    rows[9] = '9,dog,0.5,1,2,3,4,"{""text"": ""a'
    rows[20] = '20,"two\nlines",0.5,1,2,3,4,"{""a"":\n1}"'
    rows[30] = '30,cat,0.5,1,2,3,4,"'
    path = tmp_path / "d.csv"
    path.write_text("frame_ts,label,conf,x1,y1,x2,y2,extra\n" + "\n".join(rows))
    got = read_detections_with_faults(spark, str(path)).collect()
    assert sorted(r.frame_ts for r in got if r.reason is None) == [n for n in range(40) if n not in (3, 9, 30)]
    assert [r.reason for r in got if r.reason] == ["quoting"] * 3


def test_records_of_another_width_are_given_up():
    lines = ['a,"b\n', "c,d\n", 'e"\n', "f,g\n"]
    assert list(assemble_lines(lines, 2)) == ['a,"b\nc,d\ne"\n', "f,g\n"]
    assert list(assemble_lines(lines, 3)) == lines
    assert list(assemble_lines([])) == [] and list(assemble_lines(['"'])) == ['"']


@pytest.mark.parametrize("line", ['1,dog,0.5,1,2,3,4,{}\n', 'x","\n', '1,"dog,0.5,1\n', '"""x\n', '""\n', '"a\n"'])
def test_assembly_takes_linear_time(line):
    import time

    lines = ['0,"never closed\n'] + [line] * 100_000
    for fields in (None, 8):
        began = time.perf_counter()
        assert sum(map(len, assemble_lines(lines, fields))) == sum(map(len, lines))
        assert time.perf_counter() - began < 2
