"""Media columns: texts as PNG pictures, their bytes checked and undone again, and low-frequency cosine-transform hashes."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textkit import buffers, released

WIDTH = 576
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: The hash has a bit for each of LOW x LOW lowest frequencies.
LOW = 8
#: Rows that are transformed at once.
STRIP = 4096


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def filtered(rows: np.ndarray) -> np.ndarray:
    """Each row behind the byte of its filter: None, Sub or Up, whichever leaves the least sum of absolute differences."""
    sub, up = rows.copy(), rows.copy()
    sub[:, 1:] -= rows[:, :-1]
    up[1:] -= rows[:-1]
    kinds = np.stack([rows, sub, up])
    best = np.abs(kinds.view(np.int8).astype(np.int16)).sum(axis=2, dtype=np.int64).argmin(axis=0)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = kinds[best, np.arange(len(rows))]
    return out


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Undoes all five filters of 8-bit grey rows. Runs of rows of filters 0 to 2 go as whole arrays, Average and Paeth pixel by pixel."""
    kinds, rows = lines[:, 0], lines[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("a row has an unknown filter")
    at = np.flatnonzero(kinds == 1)
    rows[at] = np.cumsum(rows[at], axis=1, dtype=np.uint8)
    chained = kinds >= 2
    i = 0
    while i < len(rows):
        if not chained[i]:
            i += 1
        elif kinds[i] == 2:
            end = i
            while end < len(rows) and kinds[end] == 2:
                end += 1
            first = max(i - 1, 0)
            rows[first:end] = np.cumsum(rows[first:end], axis=0, dtype=np.uint8)
            i = end
        else:
            above = rows[i - 1].tolist() if i else [0] * rows.shape[1]
            line, left, corner = rows[i].tolist(), 0, 0
            for x, b in enumerate(above):
                if kinds[i] == 3:
                    guess = (left + b) >> 1
                else:
                    pa_, pb, pc = abs(b - corner), abs(left - corner), abs(left + b - 2 * corner)
                    guess = left if pa_ <= pb and pa_ <= pc else b if pb <= pc else corner
                left, corner = (line[x] + guess) & 255, b
                line[x] = left
            rows[i] = line
            i += 1
    return rows


def to_png(payload: bytes | np.ndarray, level: int = 2) -> bytes:
    """An 8-bit grey PNG of WIDTH columns; payload is a positive multiple of WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered(rows).tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples as rows. Raises ValueError if a checksum, the order of chunks or a size is wrong."""
    view, at, head, packed, ended = memoryview(media), len(SIGNATURE), None, [], False
    if bytes(view[:at]) != SIGNATURE:
        raise ValueError("no PNG signature")
    while at < len(view) and not ended:
        size, kind = struct.unpack_from(">I4s", view, at)
        body = view[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", view, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"bad checksum of {kind!r}")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if not head or not ended or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey picture")
    inflate = zlib.decompressobj()
    raw = b"".join([*(inflate.decompress(x) for x in packed), inflate.flush()])
    if not inflate.eof or len(raw) != head[1] * (head[0] + 1):
        raise ValueError("the samples have another size than the header says")
    return unfiltered(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


@lru_cache(64)
def _basis(n: int) -> np.ndarray:
    """The LOW lowest cosines over n samples, scaled to whole numbers so that sums are exact and equal on every machine."""
    return np.rint(4096 * np.cos(np.pi * (2 * np.arange(n)[None] + 1) * np.arange(LOW)[:, None] / (2 * n))).astype(np.int64)


def cosine_hash(rows: np.ndarray) -> bytes:
    """LOW * LOW bits: whether each low-frequency coefficient is above the median of those but the mean."""
    down, basis = _basis(len(rows)), _basis(rows.shape[1]).T.astype(np.float64)
    found = np.zeros((LOW, LOW), np.int64)  # room for 3.7 million rows, more than the 2 GB of a string make
    for i in range(0, len(rows), STRIP):
        across = (rows[i : i + STRIP].astype(np.float64) @ basis).astype(np.int64)  # whole numbers far below 2**53
        found += down[:, i : i + STRIP] @ across
    found = found.ravel()
    return np.packbits(found > np.median(found[1:])).tobytes()


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of every row: its text's UTF-8 (null: none), filled up with bytes 255 to a positive multiple of WIDTH, as a PNG.

    Every row gives one row, repeated and null ids too; other columns than doc_id and text are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = buffers(batch.column(1))
            for first in range(0, len(ids), 256):
                media, sizes = [], []
                for i in range(first, min(first + 256, len(ids))):
                    raw = data[offsets[i] : offsets[i + 1]]
                    rows = max(1, -(-len(raw) // WIDTH))
                    payload = np.full(rows * WIDTH, 255, np.uint8)
                    payload[: len(raw)] = raw
                    media.append(to_png(payload))
                    sizes.append(len(raw))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(sizes)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])
        released()

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, payload_bytes, payload_sha256, tail_crc32, feature binary) from stored PNGs, all of it from the decoded samples.

    A picture that isn't whole (a checksum, a size, a filter) fails the job; a null one gives nulls.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = []
                for media in part.column(2).to_pylist():
                    if media is None:
                        found.append((None, None, None, None))
                        continue
                    rows = from_png(media)
                    payload = rows.tobytes()
                    found.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), cosine_hash(rows)))
                kinds = pa.int64(), pa.string(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*found), kinds))], [*part.schema.names, "payload_bytes", "payload_sha256", "tail_crc32", "feature"])
        released()

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        work, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, feature binary"
    )
