"""Typed loading of raw records with the faulty ones kept apart, with a reason.

Method: records are assembled quote-aware and parsed by the strict csv reader
inside ``mapInArrow``; structural exceptions are caught before the typed field
constructors run. One pass, no shuffle: every row is judged by itself.

Reasons, the first that holds: ``quoting`` (a quoted field isn't closed or goes
on after its closing quote), ``columns`` (wrong number of fields, or a missing
part) and ``value`` (a field that isn't what its type demands).
"""

from __future__ import annotations

import csv
import json
import re
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cinetable.plans.columns import col

DETECTION = T.StructType(
    [T.StructField("frame_ts", T.DoubleType()), T.StructField("label", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in ("conf", "x1", "y1", "x2", "y2")]
    + [T.StructField("extra", T.StringType())]
)
CUE = T.StructType(
    [
        T.StructField("cue_no", T.LongType()),
        T.StructField("start_ms", T.LongType()),
        T.StructField("end_ms", T.LongType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)

_NUMBER = re.compile(r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")
_CUE_TIMES = re.compile(
    r"\s*([0-9]{2}):([0-5][0-9]):([0-5][0-9]),([0-9]{3})\s*-->\s*([0-9]{2}):([0-5][0-9]):([0-5][0-9]),([0-9]{3})\s*"
)
_INTEGER_LINE = re.compile(r"\s*[+-]?[0-9]+\s*")
_UNPRINTABLE = re.compile("[\x00-\x1f\x7f-\x9f�]")
_SPEAKER = re.compile(r"\s*\[(.*?)\]\s*(.*)", re.S)


class Fault(Exception):
    """A record that can't be loaded; its only argument is the reason."""


def split_record(raw: str) -> list[str]:
    """The fields of one CSV record; quoted fields may hold line ends."""
    csv.field_size_limit(sys.maxsize)
    try:
        records = list(csv.reader(csv_lines(raw.rstrip("\r\n")), strict=True))
    except csv.Error as error:
        raise Fault("quoting") from error
    if len(records) != 1:
        raise Fault("columns")
    return records[0]


def csv_lines(raw: str) -> list[str]:
    # str.splitlines would also split at characters that are no line ends in CSV
    return re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", raw)


def plain_number(text: str) -> float:
    text = text.strip()
    if not _NUMBER.fullmatch(text) or abs(number := float(text)) == float("inf"):
        raise Fault("value")
    return number


def _no_constant(name: str) -> None:
    raise ValueError(name)


def is_json_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text, parse_constant=_no_constant, parse_int=float), dict)
    except (ValueError, RecursionError):
        return False


def parse_detection(raw: str | None) -> tuple:
    """One detections record as typed fields, or a Fault."""
    fields = split_record(raw or "")
    if len(fields) != len(DETECTION):
        raise Fault("columns")
    ts, label, *numbers, extra = fields
    frame_ts = plain_number(ts)
    conf, x1, y1, x2, y2 = map(plain_number, numbers)
    if frame_ts < 0 or not 0 <= conf <= 1 or x2 < x1 or y2 < y1 or not label.strip():
        raise Fault("value")
    if extra.strip() and not is_json_object(extra):
        raise Fault("value")
    return frame_ts, label, conf, x1, y1, x2, y2, extra


def _bigint(text: str) -> int | None:
    """A whole number of any length; null where a bigint can't hold it."""
    digits = text.lstrip("+-").lstrip("0")
    if len(digits) > 19:  # int() refuses very long ones
        return None
    number = int(digits or "0") * (-1 if text.startswith("-") else 1)
    return number if -(2**63) <= number < 2**63 else None


def parse_cue(raw: str | None) -> tuple:
    """One subtitle block as typed fields, or a Fault. A cue number that no bigint holds is null."""
    lines = (raw or "").removeprefix("﻿").replace("\r\n", "\n").split("\n")
    while lines and not lines[-1].strip():
        lines.pop()
    number = None
    if lines and _INTEGER_LINE.fullmatch(lines[0]):
        number = _bigint(lines.pop(0).strip())
    if len(lines) < 2 or "-->" not in lines[0]:
        raise Fault("columns")
    first = lines[1].lstrip()
    if first.startswith("[") and "]" not in first:
        raise Fault("quoting")
    times = _CUE_TIMES.fullmatch(lines[0])
    if not times:
        raise Fault("value")
    h1, m1, s1, f1, h2, m2, s2, f2 = map(int, times.groups())
    start, end = ((h1 * 60 + m1) * 60 + s1) * 1000 + f1, ((h2 * 60 + m2) * 60 + s2) * 1000 + f2
    if end < start or any(_UNPRINTABLE.search(line) for line in lines[1:]):
        raise Fault("value")
    named = _SPEAKER.fullmatch(lines[1])
    speaker, head = named.groups() if named else (None, lines[1])
    return number, start, end, speaker, " ".join(x.strip() for x in [head, *lines[2:]] if x.strip())


PARSERS: dict[str, tuple[Callable[[str | None], tuple], T.StructType]] = {
    "detection": (parse_detection, DETECTION),
    "cue": (parse_cue, CUE),
}


def parse_records(df: DataFrame, kind: str, raw: str = "raw", keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, the typed fields of ``kind``, ``raw_record`` and ``reason``.

    ``kind`` is ``detection`` or ``cue``. Valid rows have typed fields and a null
    ``reason``; faulty ones keep their text in ``raw_record``, null fields and
    the reason. A null or empty record is faulty (``columns``). Repeated rows
    stay repeated, an empty table stays empty and columns outside ``keep`` are
    dropped; a kept column that is named like an output column is an error.
    """
    parse, fields = PARSERS[kind]
    names = [f.name for f in fields] + ["raw_record", "reason"]
    if clash := set(keep) & set(names):
        raise ValueError(f"kept columns collide with result columns: {sorted(clash)}")
    source = df.select(*(col(k) for k in keep), col(raw).cast("string").alias("raw_record"))
    schema = T.StructType(
        [f for f in source.schema if f.name != "raw_record"]
        + list(fields)
        + [T.StructField("raw_record", T.StringType()), T.StructField("reason", T.StringType())]
    )
    arrow = to_arrow_schema(schema)
    width = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            typed, bad, reasons = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                try:
                    typed.append(parse(text))
                    bad.append(None)
                    reasons.append(None)
                except Fault as fault:
                    typed.append((None,) * width)
                    bad.append(text)
                    reasons.append(fault.args[0])
            by_field = list(zip(*typed)) or [()] * width
            arrays = [batch.column(i).cast(arrow.field(i).type) for i in range(batch.num_columns - 1)]
            arrays += [pa.array(values, type=field.type) for values, field in zip(by_field, list(arrow)[len(arrays):])]
            arrays += [pa.array(bad, type=pa.string()), pa.array(reasons, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return source.mapInArrow(run, schema)


_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')


def _follow(line: str, quoted: bool) -> tuple[bool | None, int]:
    """(whether a quote is open at the end of a line, None if a quoted field goes on after its closing quote; commas between fields)."""
    at, commas = 0, 0
    while True:
        if quoted:
            at = _QUOTED.match(line, at).end()
            if at == len(line):
                return True, commas
            at += 1
            if at == len(line) or line[at] in "\r\n":
                return False, commas
            if line[at] != ",":
                return None, commas
        else:
            at = line.find(",", at)
            if at < 0:
                return False, commas
        at, commas = at + 1, commas + 1
        quoted = line.startswith('"', at)
        at += quoted


def assemble_lines(lines: Iterable[str], fields: int | None = None) -> Iterator[str]:
    """Physical lines of a CSV file to records: a line end inside quotes goes on.

    Quote-aware: a field is quoted only if it begins with the quote. A record
    goes over several lines only if its quotes close properly and it has
    ``fields`` fields (if given). Otherwise, in particular where a quote never closes,
    its first line is a record of its own and reading goes on behind it, so a faulty
    record takes no sound one with it. Every line is followed at most twice.
    """
    lines = list(lines)
    at = 0
    # of lines reached with an open quote: (commas up to its end, line after it), None if it never closes
    known: dict[int, tuple[int, int] | None] = {}
    while at < len(lines):
        line = lines[at]
        state, commas = _follow("," + line, False)
        end, stop, path = None, at + 1, []
        while state:
            if stop in known or stop == len(lines):
                end = known.get(stop)
                break
            path.append((stop, commas))
            state, more = _follow(lines[stop], True)
            commas, stop = commas + more, stop + 1
            if state is False:
                end = (0, stop)
        known.update((place, None if end is None else (end[0] + commas - before, end[1])) for place, before in path)
        if end is not None and fields in (None, commas + end[0]):
            yield "".join(lines[at : end[1]])
            at = end[1]
        else:
            yield line
            at += 1
