"""CPU profiles in the public pprof form (gzip, protocol buffers) as leaf-first stacks."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Field numbers of the profile message and its parts.
SAMPLE, LOCATION, FUNCTION, STRINGS = 2, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, integer or bytes) of a message, in order."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise ValueError("truncated message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        else:
            raise ValueError("unknown wire type")
        yield key >> 3, value


def _numbers(message: bytes, number: int) -> list[int]:
    out = []
    for n, v in fields(message):
        if n == number and isinstance(v, bytes):
            at = 0
            while at < len(v):
                x, at = _varint(v, at)
                out.append(x)
        elif n == number:
            out.append(v)
    return out


def stacks(blob: bytes) -> list[tuple[list[str], int]]:
    """(function names from the leaf, first sample value) of a profile."""
    raw = gzip.decompress(blob) if blob[:2] == b"\x1f\x8b" else blob
    samples, locations, functions, strings = [], {}, {}, []
    for n, v in fields(raw):
        if n == SAMPLE:
            samples.append(v)
        elif n == LOCATION:
            parts = list(fields(v))
            locations[next((x for k, x in parts if k == 1), 0)] = [_numbers(x, 1)[0] for k, x in parts if k == 4 and _numbers(x, 1)]
        elif n == FUNCTION:
            parts = dict(fields(v))
            functions[parts.get(1, 0)] = parts.get(2, 0)
        elif n == STRINGS:
            strings.append(v.decode("utf-8", "replace"))
    name = lambda f: strings[functions[f]] if f in functions and functions[f] < len(strings) else ""
    out = []
    for s in samples:
        values = _numbers(s, 2)
        out.append(([name(f) for loc in _numbers(s, 1) for f in locations.get(loc, [])], values[0] if values else 0))
    return out


def decode(profiles: DataFrame) -> DataFrame:
    """(file, stack, count) of binary profiles (file, content); a null or broken one gives no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, content in zip(b["file"], b["content"], strict=True):
                try:
                    rows += [(file, s, n) for s, n in stacks(bytes(content))] if content is not None else []
                except (ValueError, IndexError, OSError, EOFError):
                    continue
            yield pd.DataFrame(rows, columns=["file", "stack", "count"])

    return profiles.select("file", "content").mapInPandas(run, "file string, stack array<string>, count long")
