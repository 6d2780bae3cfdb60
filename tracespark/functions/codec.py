"""Raw records as bytes: encoding with SQL functions, decoding a batch of records at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import RAW_LAYOUT, RAW_SIZE


def _swapped(hexes: Column, size: int) -> Column:
    """Hexadecimal digits with the order of their bytes turned round."""
    return F.concat(*[F.substring(hexes, 2 * i + 1, 2) for i in reversed(range(size))])


def little_endian(value: Column, size: int) -> Column:
    """An integer in `size` bytes, least first."""
    v, turned = value.cast("long"), F.lit(0).cast("long")
    for i in range(size):
        turned = turned.bitwiseOR(F.shiftleft(F.shiftright(v, 8 * i).bitwiseAND(F.lit(255)), 8 * (size - 1 - i)))
    return F.unhex(F.lpad(F.hex(turned), 2 * size, "0"))


def encode(**fields: Column) -> Column:
    """A record from its fields (the inverse of decode)."""
    parts, at = [], 0
    for name, offset, size, kind in RAW_LAYOUT:
        if offset > at:
            parts.append(F.lit(bytes(offset - at)))
        value = fields[name]
        parts.append(little_endian(value, size) if kind in ("int", "signed") else F.rpad(value.cast("binary"), size, F.lit(b"\0")))
        at = offset + size
    return F.concat(*parts, F.lit(bytes(RAW_SIZE - at)))


def integer(record: Column, offset: int, size: int, *, big: bool = False, signed: bool = False) -> Column:
    """An integer out of bytes. Unsigned 64-bit values over the range of a long are null."""
    digits = F.hex(F.substring(record, offset + 1, size))
    value = F.conv(digits if big else _swapped(digits, size), 16, 10)
    value = value.cast("decimal(20,0)") if size == 8 else value.cast("long")
    if signed:
        value = F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)
    return F.expr("null").cast("long") if size > 8 else F.when(value <= F.lit(2**63 - 1).cast("decimal(20,0)"), value).cast("long") if size == 8 else value.cast("int") if signed and size == 4 else value


RECORD = np.dtype({"names": [f[0] for f in RAW_LAYOUT], "formats": [{"int": f"<u{f[2]}", "signed": f"<i{f[2]}"}.get(f[3], f"({f[2]},)u1") for f in RAW_LAYOUT], "offsets": [f[1] for f in RAW_LAYOUT], "itemsize": RAW_SIZE})
FIELDS = ", ".join(f"{name} {({'text': 'string', 'bytes': 'binary', 'signed': 'int'}).get(kind, 'long')}" for name, _, _, kind in RAW_LAYOUT)


def cut(rows: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes of each row, one after another, and where each row's begin and end."""
    return rows[np.arange(rows.shape[1]) < length[:, None]], np.append(0, np.cumsum(length))


def strings(rows: np.ndarray) -> pa.Array:
    """Each row up to its first NUL, a character for each byte."""
    ends = rows == 0
    data, at = cut(rows, np.where(ends.any(axis=1), ends.argmax(axis=1), rows.shape[1]))
    wide = data >> 7  # these take two bytes in UTF-8
    if wide.any():
        start = np.append(0, np.cumsum(1 + wide.astype(np.int64)))
        out = np.zeros(start[-1], np.uint8)
        out[start[:-1]] = np.where(wide, 0xC0 | data >> 6, data)
        out[start[:-1][wide == 1] + 1] = 0x80 | data[wide == 1] & 0x3F
        data, at = out, start[at]
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))


def fields_of(records: pa.Array) -> dict[str, pa.Array]:
    """The fields of records of RAW_SIZE bytes each. Unsigned 64-bit values over the range of a long are null."""
    first = np.frombuffer(records.buffers()[1], np.int32)[records.offset] if len(records) else 0
    data = np.frombuffer(records.buffers()[2], RECORD, len(records), first) if len(records) else np.zeros(0, RECORD)
    out: dict[str, pa.Array] = {}
    for name, _, size, kind in RAW_LAYOUT:
        v = data[name]
        if kind == "text":
            out[name] = strings(v)
        elif kind == "bytes":
            held, at = cut(v, np.minimum(data["payload_size"], size).astype(np.int64))
            out[name] = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(held)])
        elif kind == "signed":
            out[name] = pa.array(v, pa.int32())
        else:
            out[name] = pa.array(v.astype(np.int64), mask=v.astype(np.int64) < 0)
    return out


def decode(df: DataFrame, record_col: str = "record") -> DataFrame:
    """SRC-11: the record's fields beside the other columns; records that are too short are dropped.
    The payload is cut to its size, which may be larger than what the record holds."""
    others = [c for c in df.columns if c != record_col]

    # Lengths are seen to here, as a filter would have Spark make records twice that are made from columns.
    def run(batches):
        for b in batches:
            b = b.filter(pc.greater_equal(pc.binary_length(b.column(record_col)), RAW_SIZE))
            made = fields_of(pc.binary_slice(b.column(record_col), 0, RAW_SIZE))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in others], *made.values()], [*others, *made])

    schema = T.StructType([*[df.schema[c] for c in others], *T._parse_datatype_string(FIELDS)])
    return df.select(*others, record_col).mapInArrow(run, schema)
