"""Region reads of block-compressed text with an index of (bin, offset).

The text is a row of small compressed blocks (each a gzip member that tells its own size); the index lists, for
each chromosome and bin, the virtual offsets (block << 16 | byte) between which its rows lie.  A region is read
by opening only the blocks that the index names, a group of blocks to a task.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lociform.sources.genotypes import _opened, qualified

#: Fixed values of the format: its first bytes, the number of the first bin of each level and how far a position is shifted there, and the shift of the linear index.
INDEX_HEAD, LEVELS, LINEAR = b"TBI\x01", ((1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)), 14
#: The bin that holds statistics instead of rows.
META_BIN = 37450


@dataclass
class RegionIndex:
    """Which columns (from 0) tell chromosome and position, the comment character, lines to skip, and bins and linear offsets by chromosome."""

    chrom: int
    start: int
    comment: str
    skip: int
    zero_based: bool
    bins: dict[str, dict[int, list[tuple[int, int]]]]
    linear: dict[str, list[int]]


def parsed_index(raw: bytes) -> RegionIndex:
    raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    if raw[:4] != INDEX_HEAD:
        raise ValueError("not an index of (bin, offset)")
    n, form, seq, begin, _, meta, skip, names = struct.unpack_from("<8i", raw, 4)
    at = 36
    labels = raw[at : at + names].split(b"\0")[:n]
    at += names
    out = RegionIndex(seq - 1, begin - 1, chr(meta), skip, bool(form & 0x10000), {}, {})
    for label in labels:
        bins: dict[int, list[tuple[int, int]]] = {}
        (count,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(count):
            number, chunks = struct.unpack_from("<Ii", raw, at)
            flat = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)
            at += 8 + 16 * chunks
            if number != META_BIN:
                bins[number] = list(zip(flat[::2], flat[1::2]))
        (count,) = struct.unpack_from("<i", raw, at)
        out.linear[label.decode()] = list(struct.unpack_from(f"<{count}Q", raw, at + 4))
        out.bins[label.decode()] = bins
        at += 4 + 8 * count
    return out


def chunks_of(index: RegionIndex, chrom: str, start: int, end: int) -> list[tuple[int, int]]:
    """Virtual offsets, joined where they touch, of what may hold rows of positions start to end (from 1, inclusive)."""
    label = next((c for c in (chrom, chrom.removeprefix("chr"), f"chr{chrom}") if c in index.bins), None)
    if label is None or end < start:
        return []
    low, high = max(0, start - 1), max(0, end - 1)
    wanted = [0, *(b for first, shift in LEVELS for b in range(first + (low >> shift), first + (high >> shift) + 1) if b in index.bins[label])]
    linear = index.linear[label]
    least = linear[min(low >> LINEAR, len(linear) - 1)] if linear else 0
    out: list[tuple[int, int]] = []
    for a, b in sorted(c for b in wanted for c in index.bins[label].get(b, [])):
        if b <= least:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(f, first: int, last: int) -> Iterator[tuple[int, bytes]]:
    """(file offset, text) of the compressed blocks from the one at first to the one at last."""
    while first <= last:
        head = f.read_at(18, first)
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return
        (extra,) = struct.unpack_from("<H", head, 10)
        fields = head[12:18] + f.read_at(max(0, extra - 6), first + 18)
        size, at = None, 0
        while at + 4 <= extra:
            one, two, length = struct.unpack_from("<BBH", fields, at)
            if (one, two) == (66, 67):
                (size,) = struct.unpack_from("<H", fields, at + 4)
            at += 4 + length
        if size is None:
            raise ValueError("a block does not tell its size: the text is not block-compressed")
        body = f.read_at(size + 1 - 12 - extra - 8, first + 12 + extra)
        yield first, zlib.decompress(body, -15)
        first += size + 1


class Chunk(InputPartition):
    """Rows between two virtual offsets; where a chunk was cut, a line that begins at or runs over the cut is the first part's."""

    def __init__(self, begin: int, end: int, cut_before: bool, cut_after: bool) -> None:
        self.begin, self.end, self.cut_before, self.cut_after = begin, end, cut_before, cut_after


class IndexedText(DataSource):
    """spark.read.format("indexed_text"): path, index (path.tbi where not told), regions ("chr:start-end", semicolons between) and bytes (compressed, to a task)."""

    @classmethod
    def name(cls) -> str:
        return "indexed_text"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return IndexedReader(self.options)


class IndexedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("bytes", 16 << 20))
        where, name = _opened(options.get("index", self.path + ".tbi"))
        with where.open_input_file(name) as f:
            self.index = parsed_index(f.read())
        self.regions = [region(r) for r in options["regions"].split(";") if r]

    def partitions(self) -> list[Chunk]:
        found = sorted(c for r in self.regions for c in chunks_of(self.index, *r))
        out: list[tuple[int, int]] = []
        for a, b in found:  # regions may share blocks, which are read once
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], b))
            else:
                out.append((a, b))
        return [Chunk(a, b, a != one[0], b != one[1]) for one in out for a, b in self.cut(*one)]

    def cut(self, begin: int, end: int) -> Iterator[tuple[int, int]]:
        """A long chunk is cut where blocks begin, found by their sizes alone."""
        if (end >> 16) - (begin >> 16) <= self.bytes:
            yield begin, end
            return
        where, name = _opened(self.path)
        with where.open_input_file(name) as f:
            at, last = begin >> 16, end >> 16
            start = begin
            while at < last:
                head = f.read_at(18, at)
                (size,) = struct.unpack_from("<H", head, 16)
                at += size + 1
                if at - (start >> 16) >= self.bytes and at < last:
                    yield start, at << 16
                    start = at << 16
            yield start, end

    def read(self, partition: Chunk | None) -> Iterator[tuple[str]]:
        if partition is None:  # Spark asks so where there are no partitions
            return
        where, name = _opened(self.path)
        begin, end, last = partition.begin, partition.end, partition.end >> 16
        with where.open_input_file(name) as f:
            rest, skipping = b"", partition.cut_before
            for at, text in blocks(f, begin >> 16, f.size()):
                first = begin & 0xFFFF if at == begin >> 16 else 0
                # beyond the last block only a line that began before it counts
                stop = (end & 0xFFFF if at == last else 0) if at >= last else len(text) + 1
                over = lambda position: position > stop if partition.cut_after and at == last else position >= stop  # noqa: B023, E731
                position = first - len(rest)  # where the next line begins, in this block
                lines = (rest + text[first:]).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if not skipping:
                        if over(position):
                            return
                        if (row := self.row(line)) is not None:
                            yield (row,)
                    skipping = False
                    position += len(line) + 1
                if at >= last and not skipping and over(position):
                    return
            if rest and not skipping and (row := self.row(rest)) is not None:
                yield (row,)

    def row(self, line: bytes) -> str | None:
        """The line, if it is a row of one of the regions."""
        if not line or line.startswith(self.index.comment.encode()):
            return None
        cells = line.split(b"\t", max(self.index.chrom, self.index.start) + 1)
        try:
            label, pos = cells[self.index.chrom].decode().removeprefix("chr"), int(cells[self.index.start]) + self.index.zero_based
        except (IndexError, ValueError):
            return None
        return line.decode("utf-8", "replace") if any(label == c.removeprefix("chr") and a <= pos <= b for c, a, b in self.regions) else None


def region(text: str) -> tuple[str, int, int]:
    """chr:start-end as its parts; commas in numbers are left out."""
    chrom, span = text.rsplit(":", 1)
    a, b = span.replace(",", "").split("-")
    return chrom, int(a), int(b)


def read_region(spark: SparkSession, path: str, regions: list[str], index: str | None = None, bytes_to_task: int = 16 << 20) -> DataFrame:
    """value: the rows of block-compressed text that lie in the regions; only the blocks that the index names are opened."""
    spark.dataSource.register(IndexedText)
    reader = spark.read.format("indexed_text").option("regions", ";".join(regions)).option("bytes", bytes_to_task)
    return (reader if index is None else reader.option("index", qualified(spark, index))).load(qualified(spark, path))


def read_variant_region(spark: SparkSession, path: str, regions: list[str], index: str | None = None) -> DataFrame:
    """chr, pos, rsid, ref, alts of variant call text in the regions."""
    cell = F.split("value", "\t")
    rows = read_region(spark, path, regions, index).where(F.size(cell) >= 5)
    return rows.select(F.regexp_replace(cell[0], "^chr", "").alias("chr"), cell[1].try_cast("long").alias("pos"), F.nullif(cell[2], F.lit(".")).alias("rsid"), cell[3].alias("ref"), F.split(cell[4], ",").alias("alts"))


def read_deleteriousness_region(spark: SparkSession, path: str, regions: list[str], index: str | None = None) -> DataFrame:
    """chr, pos, ref, alt, raw and phred of a score file in the regions."""
    cell = F.split("value", "\t")
    rows = read_region(spark, path, regions, index).where(F.size(cell) >= 6)
    return rows.select(cell[0].alias("chr"), cell[1].try_cast("long").alias("pos"), cell[2].alias("ref"), cell[3].alias("alt"), cell[4].try_cast("double").alias("raw"), cell[5].try_cast("double").alias("phred"))
