"""Operation logs: the binary batch format, daily segments of framed batches, and their readers and writers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: magic, markers of plain and compressed envelopes, kinds of operations, sizes.
MAGIC = b"HYV1"
RAW, BROTLI = 0, 1
KINDS = {"lww": 0x10, "gset_observe": 0x20, "or_add": 0x30, "or_remove": 0x31}
CLOCK, WRITER, HASH = 12, 16, 32
VARINT_MOST = (1 << 32) - 1
#: Which log an operation belongs to.
LOGS = {"lww": "lww", "gset_observe": "gset", "or_add": "orset", "or_remove": "orset"}
#: Operations of one written batch at most.
BATCH = 512
SCHEMA = "kind string, wall long, counter int, writer binary, a string, b string, payload binary, bucket long, observed int, weight int"


class TornError(ValueError):
    """The bytes end inside a value."""


def varint(value: int) -> bytes:
    if not 0 <= value <= VARINT_MOST:
        raise ValueError(f"varint out of range: {value}")
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, next offset); TornError at the end of the bytes, ValueError beyond 32 bits."""
    value = shift = 0
    while True:
        if at >= len(data):
            raise TornError(at)
        value |= (data[at] & 0x7F) << shift
        at += 1
        if value > VARINT_MOST:
            raise ValueError(f"varint over 32 bits at {at}")
        if not data[at - 1] & 0x80:
            return value, at
        shift += 7


def encode_batch(ops: list[dict]) -> bytes:
    """A batch as one plain envelope: magic, count, table of strings in order of first use, operations.

    An operation has kind, wall, counter, writer (16 bytes), a (entity, source or claim), b (target or agent), payload (hash and body,
    claim body, or removed tags), bucket, observed, weight, as its kind needs.
    """
    table: dict[str, int] = {}
    for op in ops:
        for s in ((op["a"], op["b"]) if op["kind"] in ("gset_observe", "or_add") else (op["a"],)):
            table.setdefault(s, len(table))
    out = bytearray(MAGIC + varint(len(ops)) + varint(len(table)))
    for s in table:
        raw = s.encode()
        out += varint(len(raw)) + raw
    for op in ops:
        writer, payload = bytes(op["writer"]), bytes(op["payload"] or b"")
        if len(writer) != WRITER:
            raise ValueError("a writer has 16 bytes")
        out += bytes([KINDS[op["kind"]]]) + struct.pack(">QHH", op["wall"], op["counter"], 0) + writer + varint(table[op["a"]])
        if op["kind"] == "lww":
            out += payload[:HASH] + varint(len(payload) - HASH) + payload[HASH:]
        elif op["kind"] == "gset_observe":
            out += varint(table[op["b"]]) + struct.pack(">IHH", op["bucket"], op["observed"], op["weight"])
        elif op["kind"] == "or_add":
            out += varint(table[op["b"]]) + varint(len(payload)) + payload
        else:
            if len(payload) % (CLOCK + WRITER):
                raise ValueError("a tag has 28 bytes")
            out += varint(len(payload) // (CLOCK + WRITER)) + payload
    return bytes([RAW]) + bytes(out)


def decode_batch(data: bytes) -> list[dict]:
    """The operations of an envelope; ValueError where it is malformed. Compressed ones need the brotli module."""
    if not data:
        raise TornError(0)
    body = data[1:]
    if data[0] == BROTLI:
        import brotli  # not everywhere installed; plain envelopes don't need it

        body = brotli.decompress(body)
    elif data[0] != RAW:
        raise ValueError(f"unknown marker {data[0]}")
    if body[:4] != MAGIC:
        raise ValueError("bad magic")
    count, at = read_varint(body, 4)
    n, at = read_varint(body, at)
    table = []

    def take(size: int) -> bytes:
        nonlocal at
        if at + size > len(body):
            raise TornError(at)
        at += size
        return body[at - size : at]

    def number() -> int:
        nonlocal at
        value, at = read_varint(body, at)
        return value

    def name() -> str:
        i = number()
        if i >= len(table):
            raise ValueError(f"string {i} of {len(table)}")
        return table[i]

    for _ in range(n):
        table.append(take(number()).decode())
    kinds = {v: k for k, v in KINDS.items()}
    out = []
    for _ in range(count):
        code = take(1)[0]
        if code not in kinds:
            raise ValueError(f"unknown operation {code:#x}")
        wall, counter, reserved = struct.unpack(">QHH", take(CLOCK))
        if reserved:
            raise ValueError("reserved clock bytes are not zero")
        op = {"kind": kinds[code], "wall": wall, "counter": counter, "writer": take(WRITER), "a": None, "b": None, "payload": None, "bucket": None, "observed": None, "weight": None}
        op["a"] = name()
        if op["kind"] == "lww":
            digest = take(HASH)
            op["payload"] = digest + take(number())
        elif op["kind"] == "gset_observe":
            op["b"] = name()
            op["bucket"], op["observed"], op["weight"] = struct.unpack(">IHH", take(8))
        elif op["kind"] == "or_add":
            op["b"] = name()
            op["payload"] = take(number())
        else:
            op["payload"] = take(number() * (CLOCK + WRITER))
        out.append(op)
    return out


def split_batches(segment: bytes) -> list[bytes]:
    """The framed batches of a segment; a torn last one is left out."""
    out, at = [], 0
    while at < len(segment):
        try:
            size, start = read_varint(segment, at)
        except TornError:
            break
        if start + size > len(segment):
            break
        out.append(segment[start : start + size])
        at = start + size
    return out


def _decoded(segment: bytes) -> Iterator[dict]:
    for batch in split_batches(segment):
        try:
            ops = decode_batch(batch)
        except ValueError:
            return  # as a torn write: what follows it is not read
        yield from ops


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Operations of all segment files (type/day.log) under ``path``: type, day and the operation; a segment is read up to its first bad batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, content in zip(f["path"], f["content"], strict=True):
                kind, day = name.rsplit("/", 2)[-2:]
                rows = [{"type": kind, "day": day.removesuffix(".log"), **op} for op in _decoded(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").load(path)
    return files.select("path", "content").mapInPandas(run, "type string, day string, " + SCHEMA)


def segments(ops: DataFrame, batch: int = BATCH) -> DataFrame:
    """(type, day, part, content): framed batches of the operations of each log and day of their clocks, in clock order, some ``batch`` operations each.

    A day's operations are dealt over parts by equal shares of their clocks' order, so a busy day is not one task's work; parts append in order.
    """
    log = F.create_map(*[F.lit(x) for kv in LOGS.items() for x in kv])
    day = F.date_format(F.timestamp_millis("wall"), "yyyy-MM-dd")
    from ..operators.relational import positions

    o = positions(ops.withColumn("type", log[F.col("kind")]).withColumn("day", day), [F.col(c) for c in ("type", "day", "wall", "counter", "writer", "kind", "a")], "__nth")
    o = o.withColumn("part", F.floor((F.col("__nth") - 1) / batch).cast("long"))

    def frame(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("__nth")
        rows = f.astype(object).where(f.notna(), None).to_dict("records")
        for r in rows:
            for k in ("wall", "counter", "bucket", "observed", "weight"):
                r[k] = None if r[k] is None else int(r[k])
        blob = encode_batch(rows)
        return pd.DataFrame([{"type": rows[0]["type"], "day": rows[0]["day"], "part": int(rows[0]["part"]), "content": varint(len(blob)) + blob}])

    return o.groupBy("type", "day", "part").applyInPandas(frame, "type string, day string, part long, content binary")


def append_ops(ops: DataFrame, path: str) -> None:
    """Append to a log kept as a table, by type and day of the operations' clocks."""
    log = F.create_map(*[F.lit(x) for kv in LOGS.items() for x in kv])
    o = ops.withColumn("type", log[F.col("kind")]).withColumn("day", F.date_format(F.timestamp_millis("wall"), "yyyy-MM-dd"))
    o.write.mode("append").partitionBy("type", "day").parquet(path)


def segment_range(segments_: DataFrame, offset: int, most: int) -> DataFrame:
    """(…, bytes, size, eof): ``most`` bytes of each segment's content from an offset on."""
    size = F.octet_length("content")
    part = F.when((offset < size) & F.lit(most > 0), F.expr(f"substring(content, {offset + 1}, {max(0, most)})")).otherwise(F.lit(b"").cast("binary"))
    return segments_.withColumn("bytes", part).withColumn("size", size).withColumn("eof", offset + F.octet_length("bytes") >= F.col("size")).drop("content")


def composite_key(wall, counter, writer):
    """The 28-byte key of an operation as hex: clock, two zero bytes, writer; its order is the operations' order."""
    return F.concat(F.lpad(F.hex(wall), 16, "0"), F.lpad(F.hex(counter), 4, "0"), F.lit("0000"), F.hex(writer))
