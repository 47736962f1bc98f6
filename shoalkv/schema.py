"""The fixed schemas, the operation codes and the error types."""

from __future__ import annotations

from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Op(IntEnum):
    PUT = 0
    DELETE = 1


def _field(name: str, kind: T.DataType, number: int, nullable: bool = False) -> T.StructField:
    return T.StructField(name, kind, nullable, {"parquet.field.id": number})


#: A mutation, in the log and in the lake. The field ids never change; ``pk`` comes first. Keys compare as unsigned bytes.
MUTATION = T.StructType([
    _field("pk", T.BinaryType(), 1),
    _field("lsn", T.LongType(), 2),
    _field("op", T.IntegerType(), 3),
    _field("value", T.BinaryType(), 4, True),
])

#: The same without field ids, for files that others have written.
PLAIN = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in MUTATION.fields])

#: A published file, as the manifest describes it.
FILE_INDEX = T.StructType([
    T.StructField("location", T.StringType(), False),
    T.StructField("watermark", T.LongType(), False),
    T.StructField("pk_min", T.BinaryType(), False),
    T.StructField("pk_max", T.BinaryType(), False),
    T.StructField("file_size", T.LongType(), False),
    T.StructField("record_count", T.LongType(), False),
    T.StructField("bloom", T.BinaryType(), True),
])

MAX_LSN = (1 << 63) - 1


class StoreError(Exception):
    """Any failure of the engine."""


class CorruptLog(StoreError):
    """A frame whose checksum holds but whose content doesn't, or a torn frame before the last segment."""


class WriteStalled(StoreError):
    """Too many frozen memtables wait to be published."""

    def __init__(self, frozen: int):
        super().__init__(f"{frozen} frozen memtables wait to be published")
        self.frozen = frozen


class ConfigError(StoreError):
    pass


class PublishConflict(StoreError):
    """Another publisher has committed this watermark, or one above it."""


class CrashInjected(StoreError):
    """Raised at a crash point, for tests of recovery."""


def identified(df: DataFrame) -> DataFrame:
    """The mutation columns with their field ids, which then stand in the files written."""
    return df.select(*[df[f.name].alias(f.name, metadata=f.metadata) for f in MUTATION.fields])


def verify_columns(df: DataFrame, expected: T.StructType = MUTATION) -> None:
    """Names, order and types must match; nullability needn't, since files read back as nullable."""
    found = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    wanted = [(f.name, f.dataType.simpleString()) for f in expected.fields]
    if found != wanted:
        raise ConfigError(f"columns are {found}, expected {wanted}")
