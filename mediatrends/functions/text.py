"""Column functions for query text, transcript text, phrases and media paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One run of Unicode white space, and the characters cut from a query's end.
WHITESPACE = r"[\t-\r\x1c-\x1f \x85\p{Z}]+"
TRAILING_PUNCTUATION = "?!.,"

# File suffixes per media type.
MEDIA_SUFFIXES = {
    "video": [".mp4", ".avi", ".mov", ".mkv", ".flv", ".wmv", ".webm", ".m4v", ".mpeg", ".mpg"],
    "audio": [".mp3", ".wav", ".flac", ".aac", ".ogg", ".m4a", ".wma", ".opus", ".aiff"],
    "image": [".png", ".jpg", ".jpeg", ".webp"],
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_query(c: Column | str) -> Column:
    """Lower case, single spaces, no outer white space, no trailing ``?!.,``.

    Nothing is stripped after the punctuation is cut: ``"hello ?"`` gives ``"hello "``.
    """
    spaced = F.trim(F.regexp_replace(F.lower(_col(c)), WHITESPACE, " "))
    return F.rtrim(spaced, F.lit(TRAILING_PUNCTUATION))


def non_blank(c: Column | str) -> Column:
    """True for text with anything but spaces; other white space counts as text."""
    return F.trim(_col(c)) != ""


def strip_text(c: Column | str) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(_col(c), f"^{WHITESPACE}|{WHITESPACE}$", "")


def capitalize(c: Column | str) -> Column:
    """First character upper case, all others lower case."""
    c = _col(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def display_phrase(*candidates: Column | str) -> Column:
    """The first candidate that is neither NULL nor empty, capitalised; ``''`` if none is."""
    filled = [F.nullif(_col(c), F.lit("")) for c in candidates]
    return capitalize(F.coalesce(*filled, F.lit("")))


def file_name(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_stem(path: Column | str) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def media_type(path: Column | str) -> Column:
    """``video``, ``audio`` or ``image`` by the last suffix, else NULL."""
    suffix = F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))
    kinds = F.create_map(*[F.lit(v) for kind, names in MEDIA_SUFFIXES.items() for s in names for v in (s, kind)])
    return F.try_element_at(kinds, suffix)


def encode_top_queries(c: Column | str) -> Column:
    return F.to_json(_col(c))


def decode_top_queries(c: Column | str) -> Column:
    """Query texts from stored JSON; text that is no JSON list becomes the only element."""
    c = _col(c)
    objects = F.from_json(c, "array<struct<query:string,cnt:bigint>>")
    strings = F.from_json(c, "array<string>")
    named = F.when(F.exists(objects, lambda o: o["query"].isNotNull()), F.transform(objects, lambda o: o["query"]))
    return F.when(c.isNotNull(), F.coalesce(named, strings, F.array(c)))
