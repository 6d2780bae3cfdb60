"""Scalar functions on columns: codes, addresses, times, ids, tags, labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import EVENT_TYPES, PROTOCOLS


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each worked out once a row whatever is asked of it later: filters and
    projections aren't moved through a generator of one element."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*df.columns, made).select(*kept, *[F.col(f"__once.{n}").alias(n) for n in columns])


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def event_name(code: Column) -> Column:
    """S-01."""
    return F.coalesce(F.get(F.array(*map(F.lit, EVENT_TYPES)), code.cast("int")), F.lit("unknown"))


def protocol_name(code: Column) -> Column:
    """S-02."""
    return F.coalesce(F.get(F.array(*map(F.lit, PROTOCOLS)), code.cast("int")), F.lit("unknown"))


def dotted(address: Column) -> Column:
    """S-03: an IPv4 address whose first number is the lowest byte."""
    a = address.cast("long")
    return F.concat_ws(".", *[F.shiftright(a, 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in range(4)])


def swapped_port(port: Column) -> Column:
    """S-04: the other byte order of a 16-bit number."""
    p = port.cast("int")
    return F.shiftright(p, 8).bitwiseAND(F.lit(255)).bitwiseOR(F.shiftleft(p.bitwiseAND(F.lit(255)), 8))


def from_nanos(ns: Column) -> Column:
    """S-05."""
    return F.timestamp_micros(F.floor(ns / F.lit(1000).cast("decimal(20,0)")).cast("long"))


def from_millis(ms: Column) -> Column:
    """S-06."""
    return F.timestamp_millis(ms)


def minute_us(us: Column) -> Column:
    """S-07: the start of the minute, in microseconds."""
    return us - F.pmod(us, F.lit(60_000_000))


def month(t: Column) -> Column:
    """S-08: yyyyMM."""
    return F.date_format(t, "yyyyMM")


def millis(ns: Column) -> Column:
    """S-10."""
    return ns / 1e6


def whole_micros(ms: Column) -> Column:
    """S-11: milliseconds to whole microseconds, towards zero."""
    return F.floor(ms * 1000).cast("long")


def hashed_id(key: Column, chars: int) -> Column:
    """S-13: an id of so many hexadecimal digits that a retry gives again."""
    return F.substring(F.sha2(key, 256), 1, chars)


def connection_trace_id(pid: Column, source_ip: Column, source_port: Column, dest_ip: Column, dest_port: Column, start_ns: Column, comm: Column) -> Column:
    """S-14."""
    return hashed_id(F.concat_ws(":", *[c.cast("string") for c in (pid, source_ip, source_port, dest_ip, dest_port, start_ns, comm)]), 32)


def fnv1a_64(text: Column) -> Column:
    """S-15: FNV-1a of the UTF-8 bytes, as 16 hexadecimal digits. Two 32-bit halves, so that no product
    leaves the range of a long: the prime is 2^40 + 0x1b3."""
    low32 = F.lit(0xFFFFFFFF)

    def step(h, byte):
        low = h["low"].bitwiseXOR(F.conv(byte, 16, 10).cast("long"))
        product = low * 0x1B3
        high = (h["high"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(low32)
        return F.struct(high.alias("high"), product.bitwiseAND(low32).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    done = F.aggregate(_bytes(text), start, step, lambda h: F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0")))
    return F.lower(done)


def fnv1a_32(text: Column) -> Column:
    """S-16: FNV-1a with 32 bits, as a number."""
    step = lambda h, byte: (h.bitwiseXOR(F.conv(byte, 16, 10).cast("long")) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(_bytes(text), F.lit(0x811C9DC5).cast("long"), step)


def _bytes(text: Column) -> Column:
    """The UTF-8 bytes as pairs of hexadecimal digits."""
    return F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0))


def connection_key(pid: Column, source_ip: Column, source_port: Column, dest_ip: Column, dest_port: Column) -> Column:
    """S-17: the same key for both directions."""
    turned = (source_ip > dest_ip) | ((source_ip == dest_ip) & (source_port > dest_port))
    here, there = (F.concat_ws(":", ip, port.cast("string")) for ip, port in ((source_ip, source_port), (dest_ip, dest_port)))
    return F.concat_ws(":", pid.cast("string"), F.when(turned, there).otherwise(here), F.when(turned, here).otherwise(there))


def tags_to_text(tags: Column) -> Column:
    """S-18: k=v joined by commas, in the order of the keys."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def text_to_tags(text: Column) -> Column:
    """S-19: pieces without = are passed over; the first = of a piece parts it; the last of equal
    keys wins."""
    pieces = F.filter(F.split(text, ","), lambda p: F.contains(p, F.lit("=")))
    pairs = F.transform(pieces, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")))
    return last_wins(pairs)


def last_wins(pairs: Column) -> Column:
    """A map from (k, v) pairs where the last of equal keys wins, whatever the session's policy."""
    later = lambda held: lambda p, i: ~F.exists(F.slice(held, i + 2, F.size(held)), lambda q: q["k"] == p["k"])
    return bound(pairs, lambda held: F.map_from_entries(F.filter(held, later(held))))


def set_tag(tags: Column, key: str, value: Column) -> Column:
    """S-26."""
    others = F.map_filter(F.coalesce(tags, F.create_map().cast("map<string,string>")), lambda k, _: k != key)
    return F.map_concat(others, F.create_map(F.lit(key), value.cast("string")))


def truncated(text: Column, most: int = 512) -> Column:
    """S-20."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def described(trace_id: Column, span_id: Column, service: Column, operation: Column, duration_ms: Column) -> Column:
    """S-23."""
    return F.format_string("Span[trace=%s, span=%s, service=%s, op=%s, dur=%.2fms]", trace_id, span_id, service, operation, duration_ms)


def frame_name(service: Column, operation: Column, protocol: Column) -> Column:
    """S-24."""
    return F.concat(service, F.lit(":"), operation, F.when(F.coalesce(protocol, F.lit("")) != "", F.concat(F.lit(" ["), protocol, F.lit("]"))).otherwise(""))


def redis_trace_id(payload: Column) -> Column:
    """S-27: the word after TRACE_ID:, unless that is at the very start."""
    return F.when(F.instr(payload, "TRACE_ID:") > 1, F.regexp_extract(payload, r"(?s)TRACE_ID:([^ \r\n]*)", 1)).otherwise("")


def padded(text: Column, chars: int) -> Column:
    """PRJ-03: cut to so many characters, or filled with NUL."""
    return F.rpad(text, chars, "\x00")


def unpadded(text: Column) -> Column:
    """PRJ-04: without NULs and white space around."""
    return F.trim(F.replace(text, F.lit("\x00"), F.lit("")))
