"""Text expressions of the rule reranker and small validators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of e-mail addresses and key names.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
KEY_NAME = r"^[a-zA-Z0-9\s\-_]+$"

# The reranker's stop words.
STOP_WORDS = "the a an and or but in on at to for of with is was are were be been being".split()


def tokenize(text: Column, stop_words: list[str] | None = None, case_sensitive: bool = False) -> Column:
    """Words of [A-Za-z0-9_] without stop words and words of one byte; duplicates stay. Other letters part words.

    Stop words go by one regular expression before the split, so no lambda runs over the words. Null text: no words."""
    text = text if case_sensitive else F.lower(text)
    dropped = "|".join([*(w for w in (STOP_WORDS if stop_words is None else stop_words) if re.fullmatch(r"\w+", w, re.ASCII)), r"\w"])
    words = F.regexp_replace(F.regexp_replace(text, r"\W+", " "), rf"\b(?:{dropped})\b", "")
    return F.coalesce(F.array_remove(F.split(words, " "), ""), F.array().cast("array<string>"))


def payload_text(payload: Column) -> Column:
    """title, description, tags and content, joined by spaces; a missing key counts as empty."""
    return F.concat_ws(" ", *(F.coalesce(payload[k], F.lit("")) for k in ("title", "description", "tags", "content")))


def parse_timestamp(s: Column) -> Column:
    """RFC 3339, else a whole number: over 1e12 milliseconds, else seconds; null if neither."""
    s = F.trim(s)
    n = F.try_to_number(F.when(s.rlike(r"^-?\d{1,18}$"), s), F.lit("S999999999999999999")).cast("long")
    iso = F.when(s.rlike(r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.try_to_timestamp(s))
    return F.coalesce(iso, F.when(n > 10**12, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n)))


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a time with or without zone, as the session's wall clock shows it."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))


def matches_star(c: Column, pattern: str) -> Column:
    """One * stands for anything: prefix and suffix match; without it, equality."""
    if pattern == "*":
        return F.lit(True)
    head, star, tail = pattern.partition("*")
    if not star:
        return c == pattern
    return c.startswith(head) & c.endswith(tail) & (F.char_length(c) >= len(head) + len(tail))


def valid_email(c: Column) -> Column:
    """local@domain.tld, trimmed, of 254 bytes at most."""
    return F.coalesce(F.trim(c).rlike(EMAIL) & (F.octet_length(c) <= 254), F.lit(False))


def valid_password(c: Column) -> Column:
    """8 to 128 bytes, and three of: upper case, lower case, digit, punctuation or symbol."""
    kinds = sum((c.rlike(k).cast("int") for k in (r"\p{Lu}", r"\p{Ll}", r"\p{Nd}", r"[\p{P}\p{S}]")), F.lit(0))
    return F.coalesce(F.octet_length(c).between(8, 128) & (kinds >= 3), F.lit(False))


def valid_key_name(c: Column) -> Column:
    """1 to 50 letters, digits, spaces, hyphens and underscores, not all blank."""
    return F.coalesce((F.trim(c) != "") & (F.octet_length(c) <= 50) & c.rlike(KEY_NAME), F.lit(False))


def not_empty(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def max_length(c: Column, most: int) -> Column:
    """Whether it has most bytes or fewer; null: no."""
    return F.coalesce(F.octet_length(c) <= most, F.lit(False))


def sanitize(c: Column) -> Column:
    """Without white space around, and without control characters but new lines, tabs and carriage returns."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"[\p{Cc}&&[^\n\t\r]]", "")


def rerank_cache_key(query: Column, ids: Column, mode: str | None = None) -> Column:
    """SHA-256 of the query (with |mode=m), a pipe, and the sorted ids joined by commas."""
    head = query if mode is None else F.concat(query, F.lit(f"|mode={mode}"))
    return F.sha2(F.concat(head, F.lit("|"), F.array_join(F.sort_array(ids), ",")), 256)
