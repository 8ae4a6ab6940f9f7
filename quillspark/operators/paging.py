"""Pages by the last key of the page before, cursors that carry such keys, and filters whose parameter may be missing."""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CURSOR = 2000


def encode_cursor(*key) -> str:
    """A key as text that is safe in a URL."""
    return base64.urlsafe_b64encode(json.dumps(list(key), ensure_ascii=False, separators=(",", ":")).encode()).rstrip(b"=").decode()


def decode_cursor(cursor: str, kinds: tuple[type, ...] | None = None) -> tuple:
    """The key of a cursor; ValueError for anything that encode_cursor can't have made, or another form of key."""
    if len(cursor) > MAX_CURSOR:
        raise ValueError("cursor")
    try:
        raw = base64.b64decode(cursor.encode("ascii") + b"=" * (-len(cursor) % 4), altchars=b"-_", validate=True)
        key = json.loads(raw.decode())
    except (UnicodeError, binascii.Error, json.JSONDecodeError, RecursionError):
        raise ValueError("cursor") from None
    if not isinstance(key, list) or kinds is not None and (len(key) != len(kinds) or not all(type(k) is t for k, t in zip(key, kinds, strict=True))):
        raise ValueError("cursor")
    return tuple(key)


def keyset(columns: list[str], after: tuple | None, descending: set[str] = frozenset()) -> Column:
    """Rows behind the given key in the order of the columns; all of them without one."""
    if after is None:
        return F.lit(True)
    out, equal = F.lit(False), F.lit(True)
    for column, value in zip(columns, after, strict=True):
        c, v = F.col(column), F.lit(value)
        out, equal = out | (equal & ((c < v) if column in descending else (c > v))), equal & (c == v)
    return out


def page(df: DataFrame, behind: Column, order: list[Column], limit: int) -> DataFrame:
    """One row more than a page has, if there is one: it says that there is a next page."""
    return df.where(behind).orderBy(*order).limit(limit + 1)


def contains_text(column: str | Column, q: str) -> Column:
    """Whether a text holds q, whatever the case; % and _ are plain characters."""
    return F.contains(F.lower(column), F.lower(F.lit(q)))


def where_given(df: DataFrame, **filters) -> DataFrame:
    """Equality filters of which those without a value are left out."""
    for column, value in filters.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df
