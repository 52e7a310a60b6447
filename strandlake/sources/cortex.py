"""Binary k-mer graphs: a header between two magic words, then records of packed k-mers, coverages and edges.

Registered as the data source ``cortex``: spark.read.format("cortex").load(path).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources import files

# Fixed values of the format.
MAGIC, BASES = b"CORTEX", "ACGT"


def header(data: bytes) -> dict:
    """Version, k, words, colours, mean read lengths and totals, and where the records begin."""
    if data[:6] != MAGIC:
        raise ValueError("no magic word")
    version, k, words, colours = struct.unpack_from("<4I", data, 6)
    if version < 4:
        raise ValueError(f"version {version}")
    at = 22
    lengths = struct.unpack_from(f"<{colours}I", data, at)
    totals = struct.unpack_from(f"<{colours}Q", data, at + 4 * colours)
    at = data.find(MAGIC, at + 12 * colours)
    if at < 0:
        raise ValueError("no second magic word")
    return {"version": version, "k": k, "words": words, "colours": colours, "mean_read_len": lengths, "total_seq": totals, "start": at + 6}


def unpack(words: tuple[int, ...], k: int) -> str:
    """Bases of a k-mer, two bits each, the last base in the lowest bits of the last word."""
    n = 0
    for w in words:
        n = n << 64 | w
    return "".join(BASES[n >> 2 * i & 3] for i in reversed(range(k)))


def pack(kmer: str, words: int) -> tuple[int, ...]:
    n = 0
    for c in kmer:
        n = n << 2 | BASES.index(c)
    return tuple(n >> 64 * i & (1 << 64) - 1 for i in reversed(range(words)))


def write(path: str, k: int, rows: list[tuple[str, int, int]], mean_read_len: int = 100, total_seq: int = 0) -> None:
    """A file of one colour from (kmer, coverage, edges)."""
    words = -(-k // 32)
    with files.created(path) as f:
        f.write(MAGIC + struct.pack("<4I", 4, k, words, 1) + struct.pack("<I", mean_read_len) + struct.pack("<Q", total_seq) + MAGIC)
        for kmer, coverage, edges in rows:
            f.write(struct.pack(f"<{words}QIB", *pack(kmer, words), coverage, edges))


class _Part(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def _shape(self) -> tuple[dict, struct.Struct, int]:
        with files.opened(self.path) as f:
            head = header(f.read(1 << 16))
            f.seek(0, 2)
            one = struct.Struct(f"<{head['words']}Q{head['colours']}I{head['colours']}B")
            return head, one, (f.tell() - head["start"]) // one.size

    def partitions(self) -> list[_Part]:
        n = self._shape()[2]
        return [_Part(a, min(n, a + self.size)) for a in range(0, n, self.size)] or [_Part(0, 0)]

    def read(self, part: _Part) -> Iterator[tuple]:
        head, one, _ = self._shape()
        words, colours = head["words"], head["colours"]
        with files.opened(self.path) as f:
            f.seek(head["start"] + part.first * one.size)
            for values in one.iter_unpack(f.read((part.last - part.first) * one.size)):
                yield unpack(values[:words], head["k"]), list(values[words : words + colours]), list(values[words + colours :])


class CortexSource(DataSource):
    """Options: path, on any file system that Arrow knows, and records, the number in a partition."""

    @classmethod
    def name(cls) -> str:
        return "cortex"

    def schema(self) -> str:
        return "kmer string, coverage array<long>, edges array<int>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("records", 1_000_000)))
