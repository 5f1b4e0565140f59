"""Keyset pages and their cursors."""

from __future__ import annotations

import base64
import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..policy import UNFINISHED_JOBS, page_limit

UUID4 = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", re.I)
#: Longest cursor, and the version that cursors carry.
CURSOR_LENGTH, CURSOR_VERSION = 2048, 1


class InvalidCursor(ValueError):
    code = "INVALID_CURSOR"


def keyset_page(rows: DataFrame, keys: list[str], after: list | None = None, limit: int | None = None) -> DataFrame:
    """The next rows in descending order of ``keys``, one more than the page has if there is a further page."""
    if after is not None:
        rows = rows.where(F.struct(*keys) < F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, after)]))
    return rows.orderBy(*[F.desc(k) for k in keys]).limit(page_limit(limit) + 1)


def review_page(cases: DataFrame, status: str = "OPEN", after: list | None = None, limit: int | None = None) -> DataFrame:
    return keyset_page(cases.where(F.col("status") == status), ["created_at", "case_id"], after, limit)


def due_jobs(jobs: DataFrame, now, limit: int) -> DataFrame:
    """Unfinished jobs whose time has come, the longest due first; ``jobs.claim_jobs`` claims them."""
    return jobs.where(F.col("status").isin(UNFINISHED_JOBS)).where(F.col("dispatch_after") <= now).orderBy("dispatch_after", "job_id").limit(limit)


def _time(value: datetime) -> str:
    return value.astimezone(timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def _is_time(value) -> bool:
    try:
        return isinstance(value, str) and _time(datetime.fromisoformat(value)) == value
    except ValueError:
        return False


def _is_id(value) -> bool:
    return isinstance(value, str) and UUID4.fullmatch(value) is not None


def _is_number(value) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and 0 < value < 2**53


#: The fields of each kind of cursor, as constants or as what a value must be.
CURSORS: dict[str, dict] = {
    "record": {"kind": "record", "version": CURSOR_VERSION, "createdAt": _is_time, "id": _is_id},
    "history": {"kind": "history", "version": CURSOR_VERSION, "value": _is_number},
    "review": {"kind": "review-v1", "status": lambda value: isinstance(value, str), "created_at": _is_time, "id": _is_id},
}


def _valid(fields: dict, row: dict) -> bool:
    return row.keys() == fields.keys() and all(f(row[k]) if callable(f) else type(row[k]) is type(f) and row[k] == f for k, f in fields.items())


def encode_cursor(kind: str, **values) -> str:
    """The cursor of this kind with these values for its free fields; times are given as such."""
    fields = CURSORS[kind]
    given = {k: _time(v) if isinstance(v, datetime) else v for k, v in values.items()}
    row = {**{k: f for k, f in fields.items() if not callable(f)}, **given}
    if not _valid(fields, row):
        raise InvalidCursor(f"no values of a {kind} cursor")
    return base64.urlsafe_b64encode(json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")


def decode_cursor(kind: str, text: str) -> dict:
    """The free fields of a cursor of this kind, times as such; anything but what ``encode_cursor`` makes is refused."""
    fields = CURSORS[kind]
    try:
        if not re.fullmatch(rf"[A-Za-z0-9_-]{{1,{CURSOR_LENGTH}}}", text):
            raise ValueError
        raw = base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))
        row = json.loads(raw)
        if base64.urlsafe_b64encode(raw).decode().rstrip("=") != text or not isinstance(row, dict) or not _valid(fields, row):
            raise ValueError
    except (ValueError, TypeError) as e:
        raise InvalidCursor(f"malformed {kind} cursor") from e
    return {k: datetime.fromisoformat(row[k]) if f is _is_time else row[k] for k, f in fields.items() if callable(f)}


def encode_record_cursor(created_at: datetime, record_id: str) -> str:
    return encode_cursor("record", createdAt=created_at, id=record_id)


def decode_record_cursor(text: str) -> tuple[datetime, str]:
    return tuple(decode_cursor("record", text).values())


def encode_history_cursor(version: int) -> str:
    return encode_cursor("history", value=version)


def decode_history_cursor(text: str) -> int:
    return decode_cursor("history", text)["value"]


def encode_review_cursor(created_at: datetime, case_id: str, status: str) -> str:
    return encode_cursor("review", status=status, created_at=created_at, id=case_id)


def decode_review_cursor(text: str, status: str) -> tuple[datetime, str]:
    """Cursors are bound to the status they were made for."""
    row = decode_cursor("review", text)
    if row["status"] != status:
        raise InvalidCursor("a review cursor of another status")
    return row["created_at"], row["id"].lower()
