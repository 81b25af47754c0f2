"""When an item happened: dates and times as documents, chats and file metadata write them, resolved against the upload.

Dates without a year take the year of the upload, or the year before where they would lie after it. Everything is column
expressions; a session's time zone must be UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselink.functions import patterns as P
from caselink.operators.urls import let

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _part(text: Column, pattern: str, i: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _made(y: Column, m: Column, d: Column, hour: Column | None = None, minute: Column | None = None, second: Column | None = None) -> Column:
    zero = F.lit(0)
    return F.try_make_timestamp(y, m, d, zero if hour is None else hour, zero if minute is None else minute, (zero if second is None else second))


def _plausible(ts: Column, upload: Column) -> Column:
    return F.when(F.year(ts).between(1970, F.year(F.coalesce(upload, F.current_timestamp())) + 1), ts)


def _hour(hour: Column, half: Column) -> Column:
    """Of twelve hours and am or pm; above twelve as they are."""
    half = F.lower(half)
    return F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)


def _rolled(month: Column, day: Column, hour: Column, minute: Column, upload: Column) -> Column:
    """In the upload's year, or in the year before if that lies after the upload."""
    year = F.year(upload)
    here = _made(year, month, day, hour, minute)
    return F.when(here > upload, _made(year - 1, month, day, hour, minute)).otherwise(here)


def parse_date(value: Column, upload: Column) -> Column:
    """A date in figures (year first, day first, else month first) or with a month's name, also with a time after a date in
    figures; without a year by ``_rolled``, month first. Null where nothing fits or the year isn't plausible."""

    def parsed(t: Column) -> Column:
        g = lambda pattern, i: _int(_part(t, pattern, i))
        ymd, dmy = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$", r"^([0-9]{1,2})-([0-9]{1,2})-([0-9]{4})$"
        full = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})\s+([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?$"
        named, after, short = r"^([A-Za-z]+)\s+([0-9]{1,2})\s+([0-9]{4})$", r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})$", r"^([0-9]{1,2})-([0-9]{1,2})$"
        month = lambda pattern, i: F.element_at(F.create_map(*(F.lit(x) for k, m in enumerate(MONTHS, 1) for name in dict.fromkeys((m, m[:3])) for x in (name, k))), F.lower(F.regexp_extract(t, pattern, i)))
        ways = [_made(g(ymd, 1), g(ymd, 2), g(ymd, 3)), _made(g(dmy, 3), g(dmy, 2), g(dmy, 1)), _made(g(dmy, 3), g(dmy, 1), g(dmy, 2)),
                _made(g(full, 1), g(full, 2), g(full, 3), g(full, 4), g(full, 5), F.coalesce(g(full, 6), F.lit(0))),
                _made(g(named, 3), month(named, 1), g(named, 2)), _made(g(after, 3), month(after, 2), g(after, 1))]
        zero = F.lit(0)
        partial = [_rolled(g(short, 1), g(short, 2), zero, zero, upload), _rolled(g(short, 2), g(short, 1), zero, zero, upload)]
        return F.coalesce(*(_plausible(w, upload) for w in ways), *partial)

    clean = F.replace(F.replace(F.regexp_replace(F.trim(value), r"(?i)(?<=[0-9])(?:st|nd|rd|th)\b", ""), F.lit(","), F.lit("")), F.lit("/"), F.lit("-"))
    return let(clean, parsed)


def parse_time(value: Column) -> Column:
    """(hour, minute, second) of a time of day with 24 hours, or with 12 and am or pm; null where it is none."""

    def parsed(t: Column) -> Column:
        form = r"^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2}))?(?:\s+(am|pm))?$"
        hour, minute, second, half = _int(_part(t, form, 1)), _int(_part(t, form, 2)), F.coalesce(_int(_part(t, form, 3)), F.lit(0)), _part(t, form, 4)
        ok = (minute <= 59) & (second <= 59) & F.when(half.isNull(), hour <= 23).otherwise(hour.between(1, 12))
        return F.when(ok, F.struct(_hour(hour, half).alias("h"), minute.alias("m"), second.alias("s")))

    return let(F.regexp_replace(F.replace(F.lower(F.trim(value)), F.lit("."), F.lit(":")), r"(?<=[0-9])(am|pm)$", " $1"), parsed)


def _at(day: Column, time: Column) -> Column:
    return _made(F.year(day), F.month(day), F.dayofmonth(day), time["h"], time["m"], time["s"])


def visible_time(value: Column, upload: Column) -> Column:
    """(ts, timed) of a date in a line, with the time beside it if there is one."""

    def read(v: Column) -> Column:
        g = lambda i: _int(_part(v, P.ISO_TIME, i))
        iso = _plausible(_made(g(1), g(2), g(3), _hour(g(4), _part(v, P.ISO_TIME, 7)), g(5), F.coalesce(g(6), F.lit(0))), upload)
        day = F.coalesce(*(_part(v, p, 0) for p in P.VISIBLE_DATES))

        def with_day(d: Column) -> Column:
            rest = F.concat(F.call_function("substring_index", v, d, F.lit(1)), F.lit(" "), F.substr(v, F.instr(v, d) + F.length(d)))
            time = parse_time(_part(rest, P.VISIBLE_TIME, 1))
            date = parse_date(d, upload)
            return F.when(date.isNotNull(), F.struct(F.coalesce(_at(date, time), date).alias("ts"), time.isNotNull().alias("timed")))

        return F.when(v.rlike(P.ISO_TIME), F.when(iso.isNotNull(), F.struct(iso.alias("ts"), F.lit(True).alias("timed")))).otherwise(let(day, with_day))

    return let(value, read)


def chat_time(text: Column, upload: Column) -> Column:
    """(ts, inferred) of the first stamp of a chat: one with a year, else month and day of the upload's year."""
    g = lambda i: _int(_part(text, P.CHAT_FULL, i))
    year = F.when(g(3) < 69, g(3) + 2000).when(g(3) < 100, g(3) + 1900).otherwise(g(3))
    full = _plausible(_made(year, g(2), g(1), _hour(g(4), _part(text, P.CHAT_FULL, 7)), g(5), F.coalesce(g(6), F.lit(0))), upload)
    p = lambda i: _int(_part(text, P.CHAT_PARTIAL, i))
    partial = _rolled(p(1), p(2), p(3), p(4), upload)
    return F.when(full.isNotNull(), F.struct(full.alias("ts"), F.lit(False).alias("inferred"))).when(partial.isNotNull(), F.struct(partial.alias("ts"), F.lit(True).alias("inferred")))


def metadata_time(value: Column) -> Column:
    """A time of file metadata: as PDF, camera or ISO writers put it, in UTC."""

    def read(t: Column) -> Column:
        g = lambda i: _int(_part(t, P.PDF_TIME, i))
        z = lambda i: F.coalesce(g(i), F.lit(0))
        off = (F.coalesce(g(9), F.lit(0)) * 60 + F.coalesce(g(10), F.lit(0))) * F.when(_part(t, P.PDF_TIME, 8) == "+", -1).otherwise(1)
        pdf = F.timestamp_seconds(F.unix_timestamp(_made(g(1), g(2), g(3), z(4), z(5), z(6))) + off * 60)
        exif = r"^([0-9]{4})[:-]([0-9]{1,2})[:-]([0-9]{1,2})\s+([0-9]{1,2}):([0-9]{1,2}):([0-9]{1,2})$"
        e = lambda i: _int(_part(t, exif, i))
        iso = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(t))
        return F.when(t.startswith("D:"), pdf).otherwise(F.coalesce(_made(e(1), e(2), e(3), e(4), e(5), e(6)), iso))

    return let(F.trim(value), read)


def resolve_evidence_times(items: DataFrame) -> DataFrame:
    """(case_id, item_id, ts, source, confidence, inferred): the first that an item has of a labelled line of its text, an
    extracted date and time (``dates``, ``times``: arrays), a chat stamp, the creation times of ``exif``, ``pdf`` and
    ``office`` metadata, and its ``upload_time``."""
    text, upload = F.coalesce("text", F.lit("")), F.col("upload_time")
    lines = F.regexp_extract_all(text, F.lit(P.LABELLED_TIME), F.lit(1))
    labelled = F.get(F.filter(F.transform(lines, lambda v: visible_time(v, upload)), lambda x: x.isNotNull()), F.lit(0))
    filled = lambda c: F.get(F.filter(F.transform(c, lambda v: F.trim(v)), lambda v: v != ""), F.lit(0))
    day, time = parse_date(filled("dates"), upload), parse_time(filled("times"))
    rows = items.select("case_id", "item_id", "upload_time", labelled.alias("l"), day.alias("d"), time.alias("t"), chat_time(text, upload).alias("c"),
                        *(metadata_time(F.col(c)).alias(f"m_{c}") for c in ("exif", "pdf", "office")))
    made = lambda ts, source, confidence, inferred: F.struct(ts.alias("ts"), (source if isinstance(source, Column) else F.lit(source)).alias("source"), (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"), (inferred if isinstance(inferred, Column) else F.lit(inferred)).alias("inferred"))
    c = F.col
    words = lambda t, a, b: F.when(t, a).otherwise(b)
    first = F.coalesce(
        F.when(c("l").isNotNull(), made(c("l.ts"), words(c("l.timed"), "content_labeled_date_time", "content_labeled_date_only"), words(c("l.timed"), "high", "medium"), ~c("l.timed"))),
        F.when(c("d").isNotNull(), made(F.coalesce(_at(c("d"), c("t")), c("d")), words(c("t").isNotNull(), "content_date_time", "content_date_only"), words(c("t").isNotNull(), "high", "medium"), c("t").isNull())),
        F.when(c("t").isNotNull() & c("upload_time").isNotNull(), made(_at(c("upload_time"), c("t")), "content_time_only", "medium", True)),
        F.when(c("c").isNotNull(), made(c("c.ts"), "content_chat_timestamp", words(c("c.inferred"), "medium", "high"), c("c.inferred"))),
        *(F.when(c(f"m_{k}").isNotNull(), made(c(f"m_{k}"), f"metadata_{k}_created", "medium", False)) for k in ("exif", "pdf", "office")),
        F.when(c("upload_time").isNotNull(), made(c("upload_time"), "upload_time_fallback", "low", True)),
        made(F.lit(None).cast("timestamp"), "unresolved", "none", False))
    return rows.select("case_id", "item_id", first.alias("f")).select("case_id", "item_id", "f.*")
