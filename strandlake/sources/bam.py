"""Binary alignment files: compressed blocks, records sorted by place, and an index of places.

Registered as the data source ``bam``: spark.read.format("bam").load(path).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandlake.sources import files

# Fixed values of the format: magic words, codes of bases and of operations, the block that ends a file, the width of an index window and its bins.
MAGIC, INDEX_MAGIC = b"BAM\1", b"BAI\1"
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
WINDOW = 14
BINS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
FIELDS = "read_id string, flag int, chrom string, pos int, mapq int, cigar string, mate_chrom string, mate_pos int, insert_size int, seq string, qual string"


class Blocks:
    """A compressed file read from virtual offsets: a block's place times 65,536, plus a place in its content."""

    def __init__(self, path: str):
        self.file = files.opened(path)
        self.place, self.after, self.data, self.at = 0, 0, b"", 0

    def seek(self, offset: int) -> None:
        self.after = offset >> 16
        self._load()
        self.at = offset & 0xFFFF

    def tell(self) -> int:
        if self.at == len(self.data):
            return self.after << 16
        return self.place << 16 | self.at

    def _load(self) -> bool:
        self.place = self.after
        self.file.seek(self.place)
        head = self.file.read(12)
        if len(head) < 12:
            self.data, self.at = b"", 0
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        i, size = 0, None
        while i + 4 <= len(extra):
            length = struct.unpack_from("<H", extra, i + 2)[0]
            if extra[i : i + 2] == b"BC":
                size = struct.unpack_from("<H", extra, i + 4)[0] + 1
            i += 4 + length
        if head[:4] != b"\x1f\x8b\x08\x04" or size is None:
            raise ValueError("not a file of compressed blocks")
        self.data = zlib.decompress(self.file.read(size - 20 - len(extra)), -15)
        self.after, self.at = self.place + size, 0
        return True

    def settle(self) -> int:
        """The offset of the next byte, past blocks without content; the file's size times 65,536 at its end."""
        while self.at == len(self.data) and self._load():
            pass
        return self.tell()

    def read(self, n: int) -> bytes:
        out = []
        while n:
            if self.at == len(self.data):
                if not self._load():
                    break
                continue
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            out.append(part)
        return b"".join(out)


def header(blocks: Blocks) -> list[tuple[str, int]]:
    """Names and lengths of the references; records follow."""
    if blocks.read(4) != MAGIC:
        raise ValueError("no magic word")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


def decode(data: bytes, refs: list[tuple[str, int]]) -> tuple[tuple, int, int, int]:
    """A record's fields, its reference's number, and its first and last place, from 0."""
    ref, pos, name_len, mapq, _, n_cigar, flag, n, mate_ref, mate_pos, size = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32
    name = data[at : at + name_len - 1].decode()
    at += name_len
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    packed = data[at : at + (n + 1) // 2]
    at += len(packed)
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:n]
    qual = data[at : at + n]
    span = sum(x >> 4 for x in ops if OPERATIONS[x & 15] in "MDN=X")
    chrom = lambda r: refs[r][0].removeprefix("chr") if r >= 0 else "*"
    cigar = "".join(f"{x >> 4}{OPERATIONS[x & 15]}" for x in ops) or "*"
    text = "*" if not qual or qual[0] == 0xFF else "".join(chr(q + 33) for q in qual)
    return (name, flag, chrom(ref), pos + 1, mapq, cigar, chrom(mate_ref), mate_pos + 1, size, seq or "*", text), ref, pos, pos + max(span, 1) - 1


def _block_after(path: str, place: int) -> int:
    """Where the first compressed block at ``place`` or later begins: one that another, or the file's end, follows; the file's size if none."""
    end, window = files.size(path), 1 << 18  # a block has at most 65,536 bytes
    with files.opened(path) as f:

        def follows(at: int, n: int) -> bool:
            if n == 0 or at == end:
                return True
            f.seek(at)
            head = f.read(18)
            if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04" or head[12:14] != b"BC":
                return False
            return follows(at + struct.unpack_from("<H", head, 16)[0] + 1, n - 1)

        while place < end:
            f.seek(place)
            data = f.read(window)
            at = data.find(b"\x1f\x8b\x08\x04")
            while at >= 0:
                if follows(place + at, 3):
                    return place + at
                at = data.find(b"\x1f\x8b\x08\x04", at + 1)
            place += max(1, len(data) - 3)
    return end


def _likely(data: bytes, at: int, refs: list[tuple[str, int]]) -> int | None:
    """Where the record after one at ``at`` begins, if what is there can be one; None if it cannot. ``data`` holds its fixed fields."""
    size, ref, pos, name_len, _, _, n_cigar, _, n, mate_ref, mate_pos = struct.unpack_from("<iiiBBHHHiii", data, at)
    fits = lambda r, x: r == -1 or 0 <= r < len(refs) and -1 <= x <= refs[r][1]
    if name_len < 1 or n < 0 or size < 32 + name_len + 4 * n_cigar + (n + 1) // 2 + n or not fits(ref, pos) or not fits(mate_ref, mate_pos):
        return None
    name = data[at + 36 : at + 36 + name_len]
    if len(name) == name_len and (name[-1] or any(not 33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def record_after(path: str, place: int, refs: list[tuple[str, int]]) -> int:
    """The virtual offset of the first record that begins in the compressed blocks from byte ``place`` on.

    A place in a block is taken for a record's beginning if it and all that
    would follow it in the next blocks can be records. The reader of the part
    before ends there or fails, so a wrong guess never gives wrong rows.
    """
    end, blocks, least = files.size(path), Blocks(path), 1 << 17
    begin = _block_after(path, place)
    while begin < end:
        blocks.seek(begin << 16)
        starts, parts, total = [], [], 0
        while blocks.data or blocks.after < end:
            starts.append((total, blocks.place))
            parts.append(blocks.data)
            total += len(blocks.data)
            if total >= least or not blocks._load():
                break
        data, whole = b"".join(parts), blocks.after >= end
        for at in range(len(data)):
            i, n = at, 0
            while i is not None and i + 36 <= len(data):
                i, n = _likely(data, i, refs), n + 1
            # in a file's last blocks the records end with them
            if i is not None and n and (i == len(data) if whole else n > 2):
                start, block = max(x for x in starts if x[0] <= at)
                return block << 16 | (at - start)
        if whole:
            return end << 16
        least *= 4  # a record longer than all of these blocks
    return end << 16


def read_index(path: str) -> tuple[list[list[int]], int]:
    """For each reference the offset of the first record in each window (0 where none is), and where the last placed record's chunk ends."""
    with files.opened(path) as f:
        data = f.read()
    if data[:4] != INDEX_MAGIC:
        raise ValueError("no magic word")
    at, windows, last = 8, [], 0
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        n_bins = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bins):
            number, n_chunks = struct.unpack_from("<Ii", data, at)
            chunks = struct.unpack_from(f"<{2 * n_chunks}Q", data, at + 8)
            if number != 37450:
                last = max([last, *chunks[1::2]])
            at += 8 + 16 * n_chunks
        n = struct.unpack_from("<i", data, at)[0]
        windows.append(list(struct.unpack_from(f"<{n}Q", data, at + 4)))
        at += 4 + 8 * n
    return windows, last


def _bin(a: int, b: int) -> int:
    """The smallest bin that holds the places a to b."""
    for shift, first in reversed(BINS):
        if a >> shift == b >> shift:
            return first + (a >> shift)
    return 0


def write(path: str, refs: list[tuple[str, int]], rows: list[tuple], block: int = 0xFF00) -> None:
    """A file, and its index beside it, of rows in the order of FIELDS; placed ones are sorted, those without a place come last."""
    number = {name: k for k, (name, _) in enumerate(refs)}
    placed = lambda r: r[2] in number and r[3] > 0
    rows = sorted(rows, key=lambda r: (not placed(r), number.get(r[2], -1), r[3]))
    head = MAGIC + struct.pack("<ii", 0, len(refs)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in refs)
    out, buffer, at = [], bytearray(head), 0

    def flush() -> None:
        nonlocal at
        while buffer:
            part, deflate = bytes(buffer[:block]), zlib.compressobj(6, zlib.DEFLATED, -15)
            body = deflate.compress(part) + deflate.flush()
            whole = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\0BC\2\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
            out.append(whole)
            at += len(whole)
            del buffer[:block]

    flush()
    bins: list[dict[int, list[list[int]]]] = [{} for _ in refs]
    linear: list[dict[int, int]] = [{} for _ in refs]
    for name, flag, chrom, pos, mapq, cigar, mate_chrom, mate_pos, size, seq, qual in rows:
        ops, n = [], 0
        for c in cigar if cigar != "*" else "":
            if c.isdigit():
                n = 10 * n + int(c)
            else:
                ops.append(n << 4 | OPERATIONS.index(c))
                n = 0
        span = max(1, sum(x >> 4 for x in ops if OPERATIONS[x & 15] in "MDN=X"))
        a, b, ref = pos - 1, pos - 2 + span, number.get(chrom, -1)
        bases = "" if seq == "*" else seq
        codes = [BASES.index(c) for c in bases] + [0] * (len(bases) % 2)
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
        quality = b"\xff" * len(bases) if qual == "*" else bytes(ord(c) - 33 for c in qual)
        body = struct.pack("<iiBBHHHiiii", ref, a, len(name) + 1, mapq, _bin(a, b) if ref >= 0 else 4680, len(ops), flag, len(bases), number.get(mate_chrom, -1), mate_pos - 1, size)
        body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + quality
        if len(buffer) + len(body) + 4 > block:
            flush()
        begin = at << 16 | len(buffer)
        buffer += struct.pack("<i", len(body)) + body
        if ref >= 0 and a >= 0:
            bins[ref].setdefault(_bin(a, b), []).append([begin, at << 16 | len(buffer)])
            for w in range(a >> WINDOW, (b >> WINDOW) + 1):
                linear[ref].setdefault(w, begin)
    flush()
    with files.created(path) as f:
        f.write(b"".join(out) + LAST_BLOCK)
    with files.created(path + ".bai") as f:
        f.write(INDEX_MAGIC + struct.pack("<i", len(refs)))
        for k in range(len(refs)):
            f.write(struct.pack("<i", len(bins[k])))
            for number_, chunks in bins[k].items():
                f.write(struct.pack("<Ii", number_, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            n = max(linear[k], default=-1) + 1
            f.write(struct.pack("<i", n) + b"".join(struct.pack("<Q", linear[k].get(w, 0)) for w in range(n)))


def write_files(df: DataFrame, folder: str, refs: list[tuple[str, int]], records: int = 10_000_000) -> None:
    """A folder of files with their indexes, each written by a task, of rows with the columns of FIELDS; places ascend from file to file, and records without a place come last.

    A file has about ``records`` rows. Reads of one place that are more are
    parted by their names. A task that runs again writes its file again. Names
    of references are those in ``refs``; no rows give a file without records.
    """
    names = [n for n, _ in refs]
    known = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("chrom")) if names else F.lit(0).cast("long")
    placed = (known > 0) & (F.col("pos") > 0)
    columns = [c.split()[0] for c in FIELDS.split(", ")]
    rows = df.select(*columns, F.when(placed, known).otherwise(len(refs) + 1).alias("_ref"))
    parts = -(-rows.count() // records)
    if not parts:
        return write(f"{folder}/part-00000.bam", refs, [])

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine = [r for b in batches for r in b[columns].itertuples(index=False, name=None)]
        number = TaskContext.get().partitionId()
        write(f"{folder}/part-{number:05d}.bam", refs, mine)
        yield pd.DataFrame({"n": [len(mine)]})

    ordered = rows.repartitionByRange(parts, "_ref", "pos", F.xxhash64("read_id", "flag")).drop("_ref") if parts > 1 else rows.drop("_ref").coalesce(1)
    ordered.mapInPandas(save, "n long").collect()  # a row for each file


class _Part(InputPartition):
    """Records of a reference that begin at ``first`` to ``last``, or, at the first part of a region, reach into it; all without a place from ``offset`` on; or all that begin in the bytes ``first`` to ``last``."""

    def __init__(self, path: str, kind: str, offset: int, ref: int = -1, first: int = 0, last: int = 0, reach: int = 0):
        self.path, self.kind, self.offset, self.ref, self.first, self.last, self.reach = path, kind, offset, ref, first, last, reach


class _Reader(DataSourceReader):
    def __init__(self, path: str, regions: str, unmapped: bool, width: int, split: int):
        self.path, self.regions, self.unmapped, self.width, self.split = path, regions, unmapped, width, split

    def partitions(self) -> list[_Part]:
        return [part for path in files.members(self.path, ".bam") for part in self._parts(path)]

    def _parts(self, path: str) -> list[_Part]:
        blocks = Blocks(path)
        refs = header(blocks)
        start = blocks.settle()
        if files.size(path + ".bai") is None:
            if self.regions:
                raise ValueError(f"{path}: regions need an index")
            return [_Part(path, "all", start, first=a, last=a + self.split) for a in range(0, files.size(path), self.split)]
        windows, last = read_index(path + ".bai")
        names = {n.removeprefix("chr"): k for k, (n, _) in enumerate(refs)}
        spans = []
        for text in self.regions.split(",") if self.regions else [n for n, _ in refs]:
            name, _, places = text.strip().removeprefix("chr").partition(":")
            if name in names:
                a, _, b = places.partition("-")
                spans.append((names[name], int(a or 1) - 1, int(b or refs[names[name]][1]) - 1))
        out = []
        for ref, a, b in spans:
            offsets = windows[ref]
            for first in range(a, min(b, (len(offsets) << WINDOW) - 1) + 1, self.width):
                reach = first if first == a else -1
                stop = min(b, first + self.width - 1)
                here = [x for x in offsets[first >> WINDOW : (stop >> WINDOW) + 1] if x]
                if here:
                    out.append(_Part(path, "region", min(here), ref, first, stop, reach))
        if self.unmapped or not self.regions:
            out.append(_Part(path, "rest", last or start))
        return out

    def read(self, part: _Part | None) -> Iterator[tuple]:
        if part is None:  # no region has records
            return
        blocks = Blocks(part.path)
        refs = header(blocks)
        offset, end = part.offset, files.size(part.path) << 16
        if part.kind == "all":
            # where the header goes on beyond the part's first byte, records begin after it
            end = max(part.offset, record_after(part.path, part.last, refs))
            offset = max(part.offset, record_after(part.path, part.first, refs)) if part.first else part.offset
        if offset >= end:
            return
        blocks.seek(offset)
        while (at := blocks.settle()) < end and len(size := blocks.read(4)) == 4:
            row, ref, a, b = decode(blocks.read(struct.unpack("<i", size)[0]), refs)
            if part.kind == "all" or part.kind == "rest" and ref < 0:
                yield row
            elif part.kind == "region":
                if ref != part.ref or a > part.last:
                    return
                if a >= part.first or part.reach >= 0 and b >= part.reach:
                    yield row
        if at != end and part.kind == "all":
            raise ValueError(f"{part.path}: no record begins where one was taken to, at {end}; read it with an index or a larger split")


class BamSource(DataSource):
    """Options: path, of a file or of a folder of them, on any file system that Arrow knows; split, bytes in a partition of a file without an index; regions, as 6:28000000-34000000 with commas between, which needs an index; unmapped, true to add records without a place; width, places in a partition."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("regions", ""), self.options.get("unmapped", "false") == "true", int(self.options.get("width", 1_000_000)), int(self.options.get("split", 32 << 20)))
