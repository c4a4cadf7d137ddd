"""Zstandard frames: walking a buffer frame by frame, skippable frames, and files written by Spark.

Archives are written by Spark's own text writer, so they go through its commit protocol (a lost executor
or a speculative copy leaves no half file) to any file system Spark can reach. A row is written as its raw
bytes followed by the line separator; the separators used here are themselves part of the file format.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME_MAGIC = 0xFD2FB528
SKIPPABLE_FIRST, SKIPPABLE_LAST = 0x184D2A50, 0x184D2A5F
#: A skippable frame of no bytes, all of it ASCII: readers pass over it.
EMPTY_FRAME = struct.pack("<II", SKIPPABLE_FIRST, 0)


def skippable(payload: bytes, magic: int) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def frame_end(data: bytes, at: int) -> int:
    """Where the frame that starts at `at` ends, by its block headers."""
    head = zstandard.get_frame_parameters(data[at : at + 18])
    at += zstandard.frame_header_size(data[at : at + 18])
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a frame is cut off")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if block & 1:
            break
    at += 4 * head.has_checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def frames(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(magic, start, end) of each frame of a buffer; raises ValueError where something else stands."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError(f"{len(data) - at} stray bytes at {at}")
        magic, size = struct.unpack_from("<II", data, at)
        if SKIPPABLE_FIRST <= magic <= SKIPPABLE_LAST:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(data, at)
        else:
            raise ValueError(f"no frame at {at}")
        if end > len(data):
            raise ValueError("a frame is cut off")
        yield magic, at, end
        at = end


def write_rows(df: DataFrame, column: str, path: str, separator: bytes) -> None:
    """Write a binary column, each value followed by `separator`; a file for each partition, in its order."""
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.option("compression", "none")
        .option("encoding", "ISO-8859-1")
        .option("lineSep", separator.decode("latin-1"))
        .text(path)
    )


def read_files(df_session, path: str) -> DataFrame:
    """(path, content) of the files of a folder, one row a file."""
    return df_session.read.format("binaryFile").load(path).select("path", "content")
