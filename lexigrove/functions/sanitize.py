"""Validation and sanitising as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexigrove.errors import QueryError

MAX_QUERY_BYTES, MAX_LIMIT, DEFAULT_LIMIT, MAX_INPUT = 1000, 100, 5, 10_000

# Patterns of secrets and personal data, and what replaces them.
MASKS = [
    (r"(?i)(password|pwd|pass)\s*[:=]\s*\S+", r"$1=***"),
    (r"(?i)(api[_-]?key|token|secret)\s*[:=]\s*\S+", r"$1=***"),
    (r"(?i)(authorization|bearer)\s*[:=]\s*\S+", r"$1=***"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", "***@***.***"),
    (r"\b(?:\d{4}[-\s]?){3}\d{4}\b", "****-****-****-****"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "***-**-****"),
]

# What is removed from user input, in this order.
REMOVED = [
    r"(?i)<script[^>]*>", r"(?i)</script>", r"(?i)javascript:", r"(?i)vbscript:", r"(?i)onload\s*=", r"(?i)onerror\s*=", r"(?i)eval\s*\(", r"(?i)alert\s*\(",
    r"'", r'"', r";", r"--", r"/\*", r"\*/", r"(?i)\bunion\b", r"(?i)\bselect\b", r"(?i)\binsert\b", r"(?i)\bupdate\b", r"(?i)\bdelete\b", r"(?i)\bdrop\b",
]
UNSAFE_FILENAME = '/\\:*?"<>|'


def mask(c: Column) -> Column:
    """Secrets, addresses, card and security numbers replaced."""
    for pattern, put in MASKS:
        c = F.regexp_replace(c, pattern, put)
    return c


def sanitize_input(c: Column) -> Column:
    """Control characters, script and SQL fragments removed, white space collapsed."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", "")
    for pattern in REMOVED:
        c = F.regexp_replace(c, pattern, "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def sanitize_filename(c: Column) -> Column:
    """Unsafe characters become ``_``; spaces and dots go from the ends; at most 255 bytes, cut at a character."""
    c = F.translate(c, UNSAFE_FILENAME, "_" * len(UNSAFE_FILENAME))
    c = F.regexp_replace(c, r"^[ .]+|[ .]+$", "")
    return F.when(F.octet_length(c) <= 255, c).otherwise(F.try_validate_utf8(F.substring(c.cast("binary"), 1, 255).cast("string")))


def sanitize_path(c: Column) -> Column:
    """Null characters removed, ``..`` made ``_``, at most 4096 characters."""
    return F.substring(F.replace(F.replace(c, F.lit("\x00"), F.lit("")), F.lit(".."), F.lit("_")), 1, 4096)


def path_error(c: Column) -> Column:
    """Null for an acceptable path, else ``empty``, ``null_byte`` or ``traversal``."""
    return F.when(F.trim(c) == "", "empty").when(F.contains(c, F.lit("\x00")), "null_byte").when(F.contains(c, F.lit("..")), "traversal")


def query_text(c: Column) -> Column:
    """The accepted form of a query: control characters (but tabs and line ends) removed, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B-\x1F\x7F-\x{9F}]", ""), r"\s+", " "))


def query_error(c: Column) -> Column:
    """Null for an acceptable query, else ``empty``, ``too_long`` or ``invalid_characters``."""
    blank = F.trim(F.regexp_replace(c, r"\s+", " ")) == ""
    return (
        F.when(c.isNull() | blank, "empty")
        .when(F.octet_length(c) > MAX_QUERY_BYTES, "too_long")
        .when(c.rlike(r"[<>|&;$]"), "invalid_characters")
        .when(query_text(c) == "", "empty")
    )


def checked_limit(limit: int) -> int:
    """0 means the default; above the maximum or below 0 is an error."""
    if limit < 0:
        raise QueryError("limit must not be negative", code="invalid_limit")
    if limit > MAX_LIMIT:
        raise QueryError(f"limit must be at most {MAX_LIMIT}", code="invalid_limit")
    return limit or DEFAULT_LIMIT


def checked_input(c: Column, kind: str = "text") -> tuple[Column, Column]:
    """(sanitised value, error code) of user input that is a ``query``, ``filename``, ``path`` or plain text."""
    value = sanitize_input(c)
    error = F.when(c == "", "empty").when(F.octet_length(c) > MAX_INPUT, "too_long").when(value == "", "invalid_characters")
    if kind == "query":
        return query_text(value), F.coalesce(error, query_error(value))
    if kind == "filename":
        return sanitize_filename(value), error
    if kind == "path":
        return sanitize_path(value), F.coalesce(error, path_error(value))
    return value, error
