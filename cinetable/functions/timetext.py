"""Subtitle time text and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: As srt_text writes it: hours have two digits or more. Twelve are the most whose milliseconds a bigint holds in any case.
SRT_TIME = r"^(\d{2,12}):(\d{2}):(\d{2}),(\d{3})$"


def _ms(text: Column) -> Column:
    """Of a text that is a subtitle time: its parts lie at known places behind the hours, so one regular expression, the test, is enough."""
    first = F.substring_index(text, ":", 1)
    behind = F.length(first)
    hours, minutes, seconds, ms = (x.try_cast("bigint") for x in (first, *(text.substr(behind + at, F.lit(n)) for at, n in ((2, 2), (5, 2), (8, 3)))))
    return ((hours * 60 + minutes) * 60 + seconds) * 1000 + ms


def srt_ms(text: Column, *, strict: bool = True) -> Column:
    """``HH:MM:SS,mmm``, with more digits from 100 hours, to milliseconds (X1). Bad text raises with ``strict``, else gives null; null stays null."""
    good = text.rlike(SRT_TIME)
    bad = F.raise_error(F.concat(F.lit("no subtitle time: "), text)).cast("bigint") if strict else F.lit(None).cast("bigint")
    return F.when(text.isNull(), F.lit(None).cast("bigint")).when(good, _ms(text)).otherwise(bad)


def srt_seconds(text: Column, *, strict: bool = True) -> Column:
    return srt_ms(text, strict=strict) / 1000


def srt_whole_seconds(text: Column) -> Column:
    """Seconds rounded down; bad or null text gives 0."""
    return F.when(F.trim(text).rlike(SRT_TIME), F.floor(_ms(F.trim(text)) / 1000)).otherwise(0).cast("bigint")


def _clock(hours: Column, rest_ms: Column) -> Column:
    minutes = F.floor(rest_ms / 60_000) % 60
    seconds = F.floor(rest_ms / 1000) % 60
    return F.format_string("%02d:%02d:%02d,%03d", hours, minutes, seconds, rest_ms % 1000)


def srt_text(seconds: Column) -> Column:
    """Seconds to time text, rounded half-even to ms, at least 0; hours may exceed 99."""
    ms = F.greatest(F.bround(seconds * 1000).cast("bigint"), F.lit(0).cast("bigint"))
    return F.when(seconds.isNotNull(), _clock(F.floor(ms / 3_600_000), ms))


def srt_text_of_day(seconds: Column) -> Column:
    """Seconds to time text with milliseconds cut off and hours wrapping at 24."""
    ms = F.floor(seconds * 1000).cast("bigint")
    return F.when(seconds.isNotNull(), _clock(F.floor(ms / 3_600_000) % 24, ms))


def run_stamp() -> Column:
    """The session's time as ``yyyyMMdd-HHmmss``."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmss")
