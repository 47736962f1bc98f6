"""Names, paths and catalog text as columns and as plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ConfigError


def split_data_path(path: str) -> tuple[str, str]:
    """Bucket and prefix of an ``s3://`` path; without a slash the prefix is empty."""
    if not path.startswith("s3://"):
        raise ConfigError(f"not an s3:// path: {path}")
    bucket, _, prefix = path.removeprefix("s3://").partition("/")
    return bucket, prefix


def bucket_of(path: Column) -> Column:
    return F.when(path.startswith("s3://"), F.regexp_extract(path, "^s3://([^/]*)", 1))


def prefix_of(path: Column) -> Column:
    return F.when(path.startswith("s3://"), F.regexp_extract(path, "^s3://[^/]*/?(.*)$", 1))


def object_path(location: Column) -> Column:
    """A file's key within its bucket."""
    return F.regexp_replace(F.regexp_replace(location, "^s3://[^/]*/?", ""), "^/+", "")


def location(key_prefix: Column, path: Column) -> Column:
    return F.concat(key_prefix, path)


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def uses_tls(url: Column) -> Column:
    return url.startswith("https://")


def bench_key(i: Column) -> Column:
    """``key%08d``: byte order is the order of the numbers."""
    return F.concat(F.lit("key"), F.lpad(i.cast("string"), 8, "0"))


def padded(number: Column) -> Column:
    return F.lpad(number.cast("string"), 20, "0")


def decode_hex(text: Column) -> Column:
    """Bytes of catalog text; text that isn't hex raises, and doesn't become null."""
    return F.when(text.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("not hex: "), text)).cast("binary"))


def decode_base64(text: Column) -> Column:
    """Bytes of a bloom filter; null if the text isn't base64 of whole blocks."""
    data = F.try_to_binary(text, F.lit("base64"))
    return F.when((F.octet_length(data) > 0) & (F.octet_length(data) % 32 == 0), data)


def heap_size(pk: Column, value: Column) -> Column:
    """What a mutation costs in a memtable."""
    return (F.octet_length(pk) + F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(64)).cast("long")


_SEGMENT = re.compile(r"^(\d+)\.wal$")


def segment_start(name: str) -> int | None:
    found = _SEGMENT.match(name)
    return int(found[1]) if found else None
