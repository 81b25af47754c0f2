"""Dates and times by hand."""

import datetime

from caselink.operators.times import resolve_evidence_times

UP = datetime.datetime(2025, 3, 1, 8, 0)
SCHEMA = "case_id int, item_id int, text string, dates array<string>, times array<string>, exif string, pdf string, office string, upload_time timestamp"
at = datetime.datetime
CASES = [
    (dict(text="Date: 2025-01-09 14:05:30"), at(2025, 1, 9, 14, 5, 30), "content_labeled_date_time", "high", False),
    (dict(text="hello\nPayment Date & Time\n3rd Jan 2025 9:07 PM ok"), at(2025, 1, 3, 21, 7), "content_labeled_date_time", "high", False),
    (dict(text="Date: 31/01/2025"), at(2025, 1, 31), "content_labeled_date_only", "medium", True),
    (dict(text="Date: 01/31/2025"), at(2025, 1, 31), "content_labeled_date_only", "medium", True),
    (dict(text="Date: 2099-01-01\nTime: February 2, 2025"), at(2025, 2, 2), "content_labeled_date_only", "medium", True),
    (dict(text="Date: 40/40/2025", dates=["05-06-2024"], times=["7:08 am"]), at(2024, 6, 5, 7, 8), "content_date_time", "high", False),
    (dict(dates=["12-24"]), at(2024, 12, 24), "content_date_only", "medium", True),  # after the upload's day: the year before
    (dict(dates=["02-28"]), at(2025, 2, 28), "content_date_only", "medium", True),
    (dict(dates=["24-12"]), at(2024, 12, 24), "content_date_only", "medium", True),
    (dict(dates=["", "5 August 2024"], times=[" "]), at(2024, 8, 5), "content_date_only", "medium", True),
    (dict(times=["25:00", "7:00"], text="[5/2/25, 9:15 AM] A: hi"), at(2025, 2, 5, 9, 15), "content_chat_timestamp", "high", False),
    (dict(times=["23:59"]), at(2025, 3, 1, 23, 59), "content_time_only", "medium", True),
    (dict(text="12-30 , 22:15 hello"), at(2024, 12, 30, 22, 15), "content_chat_timestamp", "medium", True),
    (dict(exif="2024:07:01 10:11:12", pdf="D:20240101"), at(2024, 7, 1, 10, 11, 12), "metadata_exif_created", "medium", False),
    (dict(pdf="D:20240701101112+05'45'"), at(2024, 7, 1, 4, 26, 12), "metadata_pdf_created", "medium", False),
    (dict(pdf="odd", office="2024-07-01T10:00:00Z"), at(2024, 7, 1, 10), "metadata_office_created", "medium", False),
    (dict(text="nothing here 99-99, 99:99"), UP, "upload_time_fallback", "low", True),
    (dict(upload_time=None), None, "unresolved", "none", False),
    (dict(upload_time=None, dates=["12-24"]), None, "unresolved", "none", False),
]


def test_times(spark):
    empty = {"case_id": 1, "item_id": 0, "text": None, "dates": [], "times": None, "exif": None, "pdf": None, "office": None, "upload_time": UP}
    rows = [tuple((empty | {"item_id": i} | given).values()) for i, (given, *_) in enumerate(CASES)]
    got = {r.item_id: (r.ts, r.source, r.confidence, r.inferred) for r in resolve_evidence_times(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (given, *want) in enumerate(CASES):
        assert got[i] == tuple(want), (given, got[i])
