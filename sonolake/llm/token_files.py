"""Token ids in files: a zstandard frame for each document, a dictionary shared by all files, an index at the end of each.

1. One pass gives the size of the table and quantiles of doc_id; a second one the dictionary's sample: the first SAMPLE_CHARS
   characters of at most SAMPLE_ROWS documents, those whose place in the table has the smallest hash. The dictionary is trained on
   the serialised id arrays of the sample alone; every document is compressed with it.
2. Each text is tokenised and compressed where it is, and dealt to its range of doc_id by number, so only frames are shuffled.
   Repeats of an id that fills several ranges are spread over them.
3. Each range is written in order, a file of at most FILE_BYTES after another. A task names its files at random and reports them
   in the manifest, a Parquet table; what a failed or doubled task wrote is in no manifest.
4. Readers take files by manifest; ids before a file follow from the manifest, those within it from its index.

A file: MAGIC, width of an id in bytes (u32), SHA-256 of the dictionary; the frames; the index: doc_id (i64 each), whether it is null
(u8 each), frame offset (u64 each, and the end), ids (u64 each); the index's offset, the number of documents (u64 each), MAGIC.
All numbers are little-endian. Folders are on any file system that pyarrow reaches from all machines (file, hdfs, s3, gs).

Null text is empty and gives the end id alone. Null ids come first; rows of one id follow each other in any order, each with its own
frame. Texts of any length are one frame. An empty table gives no files and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packing import END, tokenize
from .util import parts, scratch

MAGIC = b"IDFRAME1"
PART_BYTES, FILE_BYTES = 64 << 20, 256 << 20
SAMPLE_ROWS, SAMPLE_CHARS, DICTIONARY_BYTES, LEVEL = 4000, 4000, 64 << 10, 3
_MANIFEST = "part long, seq long, name string, n_docs long, n_tokens long, n_bytes long"


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


class Codec:
    """Frames of id arrays with one dictionary."""

    def __init__(self, dictionary: bytes, width: int):
        self.width = width
        self.hash = hashlib.sha256(dictionary).digest()
        own = zstandard.ZstdCompressionDict(dictionary)
        own.precompute_compress(LEVEL)
        self._packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own)
        self._opener = zstandard.ZstdDecompressor(dict_data=own)

    @property
    def kind(self) -> str:
        return f"<u{self.width}"

    def packed(self, ids: np.ndarray) -> bytes:
        return self._packer.compress(ids.astype(self.kind).tobytes())

    def opened(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self._opener.decompress(frame), self.kind)


def train(samples: list[np.ndarray], width: int, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of serialised id arrays; where they are too few to train one, their bytes themselves."""
    own = [x.astype(f"<u{width}").tobytes() for x in samples]
    try:
        return zstandard.train_dictionary(size, own).as_bytes()
    except zstandard.ZstdError:
        return (b"\x01" * 8 + b"".join(own))[-size:]


def _ids(texts: list[str | None], tokenizer: str, end: int) -> Iterator[np.ndarray]:
    last = np.array([end], "<u4").tobytes()
    return (np.frombuffer(ids + last, "<u4") for ids in tokenize(texts, tokenizer))


def _width(tokenizer: str, end: int) -> int:
    from tokenizers import Tokenizer

    return 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else 4


def _sample(docs: DataFrame, n: int) -> list[str]:
    """Beginnings of SAMPLE_ROWS documents or a few less or more before the limit: those whose place has a small hash."""
    if not n:
        return []
    share = min(1.0, 1.1 * SAMPLE_ROWS / n)
    h = F.xxhash64(F.monotonically_increasing_id())
    heads = docs.select(h.alias("h"), F.substring(F.coalesce("text", F.lit("")), 1, SAMPLE_CHARS).alias("text"))
    return [r.text for r in heads.where(F.col("h") < F.lit(int((2 * share - 1) * 2.0**63) if share < 1 else 2**63 - 1)).orderBy("h", "text").limit(SAMPLE_ROWS).collect()]


def _ranges(docs: DataFrame, part_bytes: int) -> tuple[int, int, list[int]]:
    """(rows, parts for null ids, lowest doc_id of each further part); an id that fills several parts stands there as often."""
    n, nulls, size = docs.agg(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull()), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    wanted = parts(size, part_bytes)
    empty = parts(wanted * nulls, n) if nulls else 0
    if n == nulls:
        return n, empty, []
    at = [k / wanted for k in range(1, wanted)]
    bounds = docs.agg(F.percentile_approx("doc_id", at, max(10_000, 20 * wanted)) if at else F.array().cast("array<long>"), F.min("doc_id")).first()
    return n, empty, [bounds[1], *bounds[0]]


def _part(batch: pa.RecordBatch, empty: int, low: np.ndarray) -> np.ndarray:
    """The part of each row: by its id, and for an id with several parts by its place in the table."""
    place, doc_id = batch.column("place").to_numpy().astype(np.uint64), batch.column("doc_id")
    null, ids = doc_id.is_null().to_numpy(zero_copy_only=False), doc_id.fill_null(0).to_numpy()
    spread = (place * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    right, left = np.searchsorted(low, ids, "right"), np.searchsorted(low, ids, "left")
    several = right - left > 1
    first, count = np.where(several, left, np.maximum(right - 1, 0)), np.where(several, right - left, 1)
    of_id = empty + first + (spread % count.astype(np.uint64)).astype(np.int64)
    return np.where(null, (spread % np.uint64(max(empty, 1))).astype(np.int64), of_id)


class _File:
    """A file that is being written."""

    def __init__(self, folder: str, part: int, seq: int, codec: Codec):
        self.part, self.seq, self.name = part, seq, f"ids-{part:06d}-{seq:04d}-{uuid.uuid4().hex}"
        system, path = _place(folder)
        self.out = system.open_output_stream(f"{path}/{self.name}")
        head = MAGIC + struct.pack("<I", codec.width) + codec.hash
        self.out.write(head)
        self.offsets, self.doc_ids, self.nulls, self.counts = [len(head)], [], [], []

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(n)

    def close(self) -> tuple:
        index = b"".join(np.array(x, k).tobytes() for x, k in ((self.doc_ids, "<i8"), (self.nulls, "<u1"), (self.offsets, "<u8"), (self.counts, "<u8")))
        self.out.write(index + struct.pack("<QQ", self.offsets[-1], len(self.doc_ids)) + MAGIC)
        self.out.close()
        return self.part, self.seq, self.name, len(self.doc_ids), sum(self.counts), self.offsets[-1] + len(index) + 16 + len(MAGIC)


class TokenFile:
    """A file that is there: its index, and frames by their place in it."""

    def __init__(self, folder: str, name: str):
        system, path = _place(folder)
        self.file = system.open_input_file(f"{path}/{name}")
        size = self.file.size()
        at, n = struct.unpack("<QQ", self._bytes(size - len(MAGIC) - 16, 16))
        head = self._bytes(0, len(MAGIC) + 4 + 32)
        if head[: len(MAGIC)] != MAGIC or self._bytes(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError(f"{name} is no file of token ids")
        self.width, self.dictionary = struct.unpack("<I", head[len(MAGIC) : len(MAGIC) + 4])[0], head[len(MAGIC) + 4 :]
        self.doc_ids, at = np.frombuffer(self._bytes(at, 8 * n), "<i8"), at + 8 * n
        self.nulls, at = np.frombuffer(self._bytes(at, n), "<u1").astype(bool), at + n
        self.offsets, at = np.frombuffer(self._bytes(at, 8 * n + 8), "<u8").astype(np.int64), at + 8 * n + 8
        self.counts = np.frombuffer(self._bytes(at, 8 * n), "<u8").astype(np.int64)

    def _bytes(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def frame(self, i: int) -> bytes:
        return self._bytes(int(self.offsets[i]), int(self.offsets[i + 1] - self.offsets[i]))

    def frames(self, most: int = 8 << 20) -> Iterator[tuple[int, bytes]]:
        """All frames in order; about `most` bytes are read at once."""
        i = 0
        while i < len(self.counts):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + most, "right")) - 1)
            data = self._bytes(int(self.offsets[i]), int(self.offsets[j] - self.offsets[i]))
            for k in range(i, j):
                yield k, data[self.offsets[k] - self.offsets[i] : self.offsets[k + 1] - self.offsets[i]]
            i = j


def _dictionary_name(digest: bytes) -> str:
    return f"dictionary-{digest.hex()}"


def _codec(folder: str, file: TokenFile) -> Codec:
    system, path = _place(folder)
    with system.open_input_stream(f"{path}/{_dictionary_name(file.dictionary)}") as f:
        codec = Codec(f.read(), file.width)
    if codec.hash != file.dictionary:
        raise ValueError("the dictionary is not the one of the file")
    return codec


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int = END, part_bytes: int = PART_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes doc_id and text of `docs` to a new folder; the manifest."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark, width = docs.sparkSession, _width(tokenizer, end)
    n, empty, low = _ranges(docs, part_bytes)
    dictionary = train(list(_ids(_sample(docs, n), tokenizer, end)), width)
    system, path = _place(folder)
    system.create_dir(path)
    with system.open_output_stream(f"{path}/{_dictionary_name(hashlib.sha256(dictionary).digest())}") as f:
        f.write(dictionary)
    bounds = np.array(low, np.int64)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(dictionary, width)
        for batch in batches:
            part = _part(batch, empty, bounds)
            for at in range(0, len(batch), 512):
                some = batch.slice(at, 512)
                ids = list(_ids(some.column("text").to_pylist(), tokenizer, end))
                columns = [pa.array(part[at : at + 512], pa.int32()), some.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([codec.packed(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n", "frame"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file, done = Codec(dictionary, width), None, []
        for batch in batches:
            for part, doc_id, n, frame in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "frame")), strict=True):
                if file is not None and (file.part != part or file.offsets[-1] + len(frame) > file_bytes):
                    done.append(file.close())
                    file = _File(folder, part, file.seq + 1 if file.part == part else 0, codec)
                file = file or _File(folder, part, 0, codec)
                file.add(doc_id, n, frame)
        if file is not None:
            done.append(file.close())
        names = [c.split()[0] for c in _MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(list(zip(*done, strict=True)) or [[]] * 6)], names=names)

    frames = docs.withColumn("place", F.monotonically_increasing_id()).mapInArrow(packed, "part int, doc_id long, n long, frame binary")
    dealt = frames.repartitionById(max(1, empty + len(low)), F.col("part"))
    dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "frame").mapInArrow(write, _MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with the ids before each file (a window over one row for each file)."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("n_tokens").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    return manifest.select("name", before).repartition("name")


def _doc_ids(file: TokenFile, at) -> pa.Array:
    return pa.array(file.doc_ids[at], mask=file.nulls[at])


def read_token_files(spark: SparkSession, folder: str, keep: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(folder, name)
                codec = _codec(folder, file)
                starts = before + np.cumsum(file.counts) - file.counts
                rows: list[tuple] = []
                for i, frame in file.frames():
                    ids = codec.opened(frame).astype("<u4")
                    rows.append((i, len(ids), zlib.crc32(ids.tobytes()), ids if keep else None))
                    if len(rows) == 512 or i == len(starts) - 1:
                        at = np.array([r[0] for r in rows])
                        columns = [_doc_ids(file, at), pa.array(starts[at]), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
                        columns += [pa.array([r[3] for r in rows], pa.list_(pa.int64()))] if keep else []
                        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                        rows = []

    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep else ""))


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, name and number in its file of every document, from the files' indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column("name").to_pylist(), batch.column("before").to_pylist(), strict=True):
                file = TokenFile(folder, name)
                n = len(file.counts)
                columns = [_doc_ids(file, slice(None)), pa.array(before + np.cumsum(file.counts) - file.counts), pa.array(file.counts), pa.array([name] * n, pa.string()), pa.array(np.arange(n))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "name", "i"])

    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, name string, i long")


def read_documents(wanted: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, ids of the documents whose doc_id is in `wanted`; of a file only the index and their frames are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, TokenFile, Codec] | None = None
        for batch in batches:
            found = []
            for name, i in zip(batch.column("name").to_pylist(), batch.column("i").to_pylist(), strict=True):
                if open_ is None or open_[0] != name:
                    file = TokenFile(folder, name)
                    open_ = name, file, _codec(folder, file)
                found.append(open_[2].opened(open_[1].frame(i)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    index = token_index(wanted.sparkSession, folder).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return index.repartition("name").sortWithinPartitions("name", "i").mapInArrow(run, "doc_id long, start long, ids array<long>")


def fresh_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, for a run of a query."""
    base = scratch(spark)
    return f"{base}/token-files-{uuid.uuid4().hex}"
