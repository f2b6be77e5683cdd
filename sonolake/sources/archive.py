"""ZIP archives as a data source: partitions are planned from the central directory, and each task reads its own entries."""

from __future__ import annotations

import fnmatch
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sonolake.sources import objects

SCHEMA = "archive string, entry string, size long, content binary"
INDEX = "filename string, fold int, target int, category string"
_LOCAL = struct.Struct("<4s5H3L2H")  # the header before an entry's bytes


class Entries(InputPartition):
    """Entries of one archive: (name, offset of the header, packed size, size, method, CRC)."""

    def __init__(self, archive: str, entries: list[tuple[str, int, int, int, int, int]]):
        self.archive, self.entries = archive, entries


def planned(archive: str, pattern: str, most: int) -> list[InputPartition]:
    """Runs of matching entries in the order they lie in, of about `most` packed bytes each."""
    system, path = objects.place(archive)
    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
        own = [(i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for i in z.infolist() if not i.is_dir() and fnmatch.fnmatch(i.filename, pattern)]
    out, held = [], most
    for entry in sorted(own, key=lambda e: e[1]):
        if held >= most:
            out.append(Entries(archive, []))
            held = 0
        out[-1].entries.append(entry)
        held += entry[2]
    return out


def unpacked(f: pa.NativeFile, entry: tuple[str, int, int, int, int, int]) -> bytes:
    """The bytes of an entry, checked."""
    name, offset, packed, size, method, crc = entry
    head = _LOCAL.unpack(f.read_at(_LOCAL.size, offset))
    data = f.read_at(packed, offset + _LOCAL.size + head[9] + head[10])
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompress(data, -15)
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"{name}: packed by method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError(f"{name}: damaged")
    return data


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.archives = options["path"].split(",")
        self.pattern, self.most = options.get("pattern", "*"), int(options.get("partitionBytes", str(32 << 20)))

    def partitions(self) -> list[InputPartition]:
        return [p for a in self.archives for p in planned(a, self.pattern, self.most)]

    def read(self, partition: Entries) -> Iterator[pa.RecordBatch]:
        system, path = objects.place(partition.archive)
        with system.open_input_file(path) as f:
            for entry in partition.entries:
                columns = [pa.array([partition.archive]), pa.array([entry[0]]), pa.array([entry[3]], pa.int64()), pa.array([unpacked(f, entry)], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["archive", "entry", "size", "content"])


class ZipArchive(DataSource):
    """spark.dataSource.register(ZipArchive); spark.read.format("zip_archive").option("pattern", "*.wav").load(archive)

    Several archives are given with commas between them. Encrypted entries and methods other than deflate are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def entries(spark: SparkSession, archives: list[str], pattern: str = "*") -> DataFrame:
    spark.dataSource.register(ZipArchive)
    return spark.read.format("zip_archive").option("pattern", pattern).load(",".join(archives))


def dataset(spark: SparkSession, archives: list[str], index: str = "*/meta/*.csv", audio: str = "*/audio/*.wav", categories: list[str] | None = None) -> DataFrame:
    """filename, fold, target, category, content of a dataset's audio: the entries that its index, a CSV table within the archive, names."""
    text = F.decode("content", "UTF-8")
    line = F.explode(F.slice(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), F.lit(2), F.lit(1 << 30)))
    order = F.from_csv("line", INDEX)
    known = entries(spark, archives, index).select("archive", line.alias("line")).where("line <> ''").select("archive", order.alias("r")).select("archive", "r.*")
    if categories is not None:
        known = known.where(F.col("category").isin(categories))
    sound = entries(spark, archives, audio).select("archive", F.substring_index("entry", "/", -1).alias("filename"), "content")
    return known.join(sound, ["archive", "filename"]).drop("archive")
