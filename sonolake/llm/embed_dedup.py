"""Near-duplicate vectors by PCA-ordered tiled comparison.

1. The second-moment matrix (dimensions squared, whatever the input) of the vectors, normalised in double precision, is summed
   over all of them, and its eigenvectors, largest first, give the order of dimensions.
2. Equal vectors, by two 64-bit hashes of their values, form one class; ids, hashes and the first principal coordinate are all
   that is shuffled for it.
3. Vectors are dealt to tiles by their first principal coordinate, with quantile bounds over classes. Unit vectors at cosine c are
   at most sqrt(2 - 2c) apart, so tiles whose ranges are further apart are never compared. A vector is shuffled once, to its
   tile, and a tile is written once, as one row of a Parquet table in the shared folder: 4 or 8 bytes a value, as the table has them.
4. Pairs of tiles are numbered, and a task reads the tiles of its numbers from that table, so disk and shuffle grow with the
   vectors and only work and reads with the pairs of tiles. Block by block, one matrix product in single precision of the leading
   dimensions and the norms of the rest bounds all cosines from above (with room for its rounding).
   What the bound leaves is decided by the full cosine of the original values in double precision.
5. Each piece of work returns link counts and a spanning forest, never all pairs; the forests' components are
   the groups.

Vectors of different lengths have no cosine: each length that occurs more than once is compared by itself.
Null, empty, zero and non-finite vectors, vectors with null components and rows with a null id link with nothing.
Repeated rows count as separate vectors in n_links. Very long vectors get tiles of fewer vectors; an empty table gives no rows;
other columns are ignored. The shared folder is on any file system that pyarrow reaches from all machines (file, hdfs, s3, gs).
"""

from __future__ import annotations

import math
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .util import components, cut, parts, scratch

THRESHOLD = 0.9
TILE, BLOCK = 32768, 512
TILE_BYTES = 8 << 20  # of a tile's values; longer vectors have tiles of fewer
PAIRS_A_TASK = 16  # of tiles, at most
_SLICE, _FOUND = 1 << 16, 1 << 20  # pairs whose cosine is taken at once; links that wait to be united


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def bounding(x: np.ndarray, turn: np.ndarray, lead: int) -> np.ndarray:
    """The leading principal coordinates of unit rows and the norm of the others: products of two such rows bound the cosine."""
    r = x @ turn[:, :lead]
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", r, r)))
    return np.column_stack([r, rest]).astype(np.float32)


def leading(values: np.ndarray, least: float) -> int:
    """Dimensions that part most pairs: chance products of the leading ones stay below what the others leave to reach `least`."""
    share = np.maximum(values, 0) / max(values.sum(), 1e-300)
    for s in range(8, len(values), 8):
        if least - share[s:].sum() >= 3.5 * np.sqrt(np.sum(share[:s] ** 2)):
            return s
    return len(values)


def near_pairs(a: np.ndarray, b: np.ndarray, ba: np.ndarray, bb: np.ndarray, least: float, room: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with cosine >= least between unit rows a and b; ba, bb: their bounding rows; room: memory for the bounds, and for which of them reach `least`."""
    m, n = len(a), len(b)
    bound = np.matmul(ba, bb.T, out=room[0][: m * n].reshape(m, n))
    # each product is off by at most (lead + 3) * 2**-24, as the rows have norm 1
    np.greater_equal(bound, np.float32(least - (ba.shape[1] + 8) * 2.0**-23), out=room[1][: m * n].reshape(m, n))
    alive = room[1][: m * n + -m * n % 8]
    alive[m * n :] = False
    count = np.count_nonzero(alive)
    if not count:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    exact = lambda i, j: np.concatenate([np.einsum("ij,ij->i", a[i[k : k + _SLICE]], b[j[k : k + _SLICE]]) >= least for k in range(0, len(i), _SLICE)])
    if count * 8 < m * n:
        eight = np.flatnonzero(alive.view(np.uint64))  # the few that are left are found by eights first
        k, at = np.nonzero(alive.reshape(-1, 8)[eight])
        i, j = np.divmod(eight[k] * 8 + at, n)
        keep = exact(i, j)
        return i[keep], j[keep]
    full = a @ b.T  # many are alike; the few that rounding may turn are taken one by one
    near = full >= least
    i, j = np.nonzero(np.abs(full - least) < 1e-12)
    if len(i):
        near[i, j] = exact(i, j)
    return np.nonzero(near)


class _Distinct:
    """Distinct vectors, as bytes, with their smallest id and number of rows."""

    def __init__(self):
        self.at: dict[bytes, int] = {}
        self.rep: list[int] = []
        self.copies: list[int] = []

    def add(self, vectors: list[bytes], reps: list[int], copies: list[int]) -> None:
        for v, rep, n in zip(vectors, reps, copies, strict=True):
            k = self.at.setdefault(v, len(self.rep))
            if k == len(self.rep):
                self.rep.append(rep)
                self.copies.append(n)
            else:
                self.rep[k] = min(self.rep[k], rep)
                self.copies[k] += n


def _flat(batch: pa.RecordBatch, kind: np.dtype) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values of all vectors, where each begins and the end, which rows have an id and a vector); null components are NaN."""
    column = batch.column("v")
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(kind, copy=False)
    there = [batch.column(c).is_valid().to_numpy(zero_copy_only=False) for c in ("vec_id", "v")]
    return values, offsets - offsets[0], there[0] & there[1]


def _lengths(batch: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    """The length of each vector that can have links, else 0."""
    values, offsets, there = _flat(batch, kind)
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
    return np.where(there & (total(~np.isfinite(values)) == 0) & (total(values != 0) > 0), np.diff(offsets), 0)


def _of_length(batch: pa.RecordBatch, d: int, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of the vectors of d components that can have links."""
    values, offsets, there = _flat(batch, kind)
    mine = np.flatnonzero(there & (np.diff(offsets) == d))
    x = values.reshape(-1, d) if len(mine) * d == len(values) else values[offsets[mine][:, None] + np.arange(d)]
    ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return batch.column("vec_id").take(pa.array(mine[ok])).to_numpy(), x[ok] + kind.type(0)  # + 0.0 makes -0.0 and 0.0 equal


def _binary(x: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * width).astype(np.int32)), pa.py_buffer(x.tobytes())])


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = THRESHOLD, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    single = isinstance(vectors.select(F.col(vector_col)).schema[0].dataType.elementType, T.FloatType)
    kind = np.dtype(np.float32 if single else np.float64)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))

    def length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(_lengths(b, kind))], names=["vec_id", "d"])

    sized = rows.mapInArrow(length, "vec_id long, d long")
    out, compared = None, []
    for r in sized.where("d > 0").groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toLocalIterator():  # one comparison for each length that occurs more than once
        part = _of_one_length(rows, int(r.d), kind, least, max(1, min(tile, tile_bytes // (kind.itemsize * r.d))))
        out, compared = part if out is None else out.union(part), [*compared, r.d]
    alone = sized.where(~F.col("d").isin(compared)) if compared else sized
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return alone if out is None else out.union(alone)


def _of_one_length(rows: DataFrame, d: int, kind: np.dtype, least: float, tile: int) -> DataFrame:
    """The result for sound vectors of d components."""
    spark = rows.sparkSession

    def moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for b in batches:
            x = unit(_of_length(b, d, kind)[1])
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["at", "m"])

    sums = np.zeros(d * d)
    for r in rows.mapInArrow(moment, "at long, m double").groupBy("at").agg(F.sum("m").alias("m")).toLocalIterator():
        sums[r["at"]] = r.m
    spread, turn = np.linalg.eigh(sums.reshape(d, d))
    turn = turn[:, ::-1].copy()
    lead = leading(spread[::-1], least)

    def coordinate(x: np.ndarray) -> np.ndarray:
        """The first principal coordinate, by steps whose rounding depends on the vector alone, so that equal ones meet in one tile."""
        top = np.abs(x).max(axis=1).astype(np.float64)
        along, square = np.zeros(len(x)), np.zeros(len(x))
        for k in range(d):
            u = x[:, k] / top
            along += u * turn[k, 0]
            square += u * u
        return along / np.sqrt(square)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _of_length(b, d, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(coordinate(x)), _binary(x)], names=["vec_id", "x", "v"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = _of_length(b, d, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _binary(x)], names=["vec_id", "v"])

    def hashed(df: DataFrame) -> DataFrame:
        """Two hashes of a vector stand for it."""
        return df.withColumns({f"h{k}": F.xxhash64(F.lit(k), "v") for k in (1, 2)}).drop("v")

    classes = cut(hashed(rows.mapInArrow(place, "vec_id long, x double, v binary")).groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("x").alias("x")))
    n, cores = classes.count(), spark.sparkContext.defaultParallelism
    n_tiles = max(parts(n, tile), min(parts(n, BLOCK), math.ceil(math.sqrt(8 * cores))))  # at least some pairs of tiles for each core
    bounds = np.array(classes.approxQuantile("x", [k / n_tiles for k in range(1, n_tiles)], 0.1 / n_tiles) if n_tiles > 1 else [])
    width = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-9
    # tile t lies between bounds t - 1 and t, so the tiles within `width` above it are those to last[t]
    lows, highs = np.concatenate([[-np.inf], bounds]), np.concatenate([bounds, [np.inf]])
    last = np.searchsorted(lows, highs + width, "right") - 1
    before = np.concatenate([[0], np.cumsum(last - np.arange(n_tiles) + 1)])  # pairs of tiles (a, b), a <= b, by a and then b

    def own(x: np.ndarray) -> np.ndarray:
        """The tile of each vector. Vectors of one coordinate share a range; a salt of their values keeps their tiles small."""
        at = coordinate(x)
        lo, hi = np.searchsorted(bounds, at, "left"), np.searchsorted(bounds, at, "right")
        salt, words = np.zeros(len(x), np.uint64), x.view(np.uint32)
        for k, odd in enumerate(K.powers(words.shape[1])[0][: words.shape[1]] if (hi > lo).any() else []):
            salt += K.mix(words[:, k].astype(np.uint64) + np.uint64(k)) * odd
        return lo + (K.mix(salt) % (hi - lo + 1).astype(np.uint64)).astype(np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Copies that a task meets among up to a tile's vectors are sent as one."""
        seen = _Distinct()

        def send() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(seen.at), kind).reshape(-1, d)
            return pa.RecordBatch.from_arrays([pa.array(own(x), pa.int32()), pa.array(seen.rep, pa.int64()), pa.array(seen.copies, pa.int64()), _binary(x)], names=["own", "rep", "copies", "v"])

        for b in batches:
            ids, x = _of_length(b, d, kind)
            for k in range(0, len(ids), tile):
                seen.add(_binary(x[k : k + tile]).to_pylist(), ids[k : k + tile].tolist(), [1] * len(ids[k : k + tile]))
                if len(seen.rep) >= tile:
                    yield send()
                    seen = _Distinct()
        if seen.rep:
            yield send()

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile as one row; a task has the rows of one tile, and keeps its distinct vectors alone."""
        tiles: dict[int, _Distinct] = defaultdict(_Distinct)
        for b in batches:
            at = b.column("own").to_numpy()
            for t in np.unique(at):
                some = pa.array(np.flatnonzero(at == t))
                tiles[int(t)].add(*(b.column(c).take(some).to_pylist() for c in ("v", "rep", "copies")))
        for t, seen in tiles.items():
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([seen.rep], pa.list_(pa.int64())), pa.array([seen.copies], pa.list_(pa.int64())), pa.array([b"".join(seen.at)], pa.binary())], names=["own", "rep", "copies", "v"])

    folder = f"{scratch(spark)}/tiles-{uuid.uuid4().hex}"
    dealt = rows.mapInArrow(deal, "own int, rep long, copies long, v binary").repartitionById(n_tiles, F.col("own"))
    tiles = dealt.mapInArrow(gathered, "own int, rep array<long>, copies array<long>, v binary")
    tiles.write.options(**{"compression": "none", "parquet.enable.dictionary": "false"}).partitionBy("own").parquet(folder)

    def read(t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, copies, unit rows, bounding rows) of a tile."""
        system, path = fs.FileSystem.from_uri(folder)
        rep, copies, v = [], [], []
        for f in system.get_file_info(fs.FileSelector(f"{path}/own={t}", allow_not_found=True)):  # a tile of no vectors has no file
            if f.path.endswith(".parquet"):
                with system.open_input_file(f.path) as file:
                    own = pq.ParquetFile(file).read()
                for c, to in (("rep", rep), ("copies", copies)):
                    to.append(K.flat(own.column(c))[0])
                v += own.column("v").to_pylist()
        joined = lambda c: np.concatenate([np.zeros(0, np.int64), *c])
        x = unit(np.frombuffer(b"".join(v), kind).reshape(-1, d)) if v else np.zeros((0, d))
        return joined(rep), joined(copies), x, bounding(x, turn, lead)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        room, a, one = (np.empty(BLOCK * BLOCK, np.float32), np.empty(BLOCK * BLOCK + 8, bool)), None, None
        for batch in batches:
            for k in batch.column("id").to_numpy():
                if a != (t := int(np.searchsorted(before, k, "right")) - 1):
                    a, one = t, read(t)
                b = a + int(k - before[a])
                yield pair(one, one if a == b else read(b), a == b, room)

    def pair(one: tuple, other: tuple, same: bool, room: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        n = len(one[0])
        reps, copies = (one[k] if same else np.concatenate([one[k], other[k]]) for k in (0, 1))
        links, label, found, waiting = np.zeros(len(reps), np.int64), np.arange(len(reps)), [], 0

        def unite() -> None:
            i, j = (np.concatenate(c) for c in zip(*found, strict=True))
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            K.unite(label, i, j)

        for p in range(0, n, BLOCK):
            for q in range(p if same else 0, len(other[0]), BLOCK):
                i, j = near_pairs(one[2][p : p + BLOCK], other[2][q : q + BLOCK], one[3][p : p + BLOCK], other[3][q : q + BLOCK], least, room)
                i, j = i + p, j + (q if same else q + n)
                if same and p == q:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    found.append((i, j))
                    waiting += len(i)
                if waiting > _FOUND:
                    unite()
                    found, waiting = [], 0
        if found:
            unite()
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(reps[label[some]]), pa.array(links[some])], names=["a", "b", "links"])

    n_pairs = int(before[-1])
    tasks = spark.range(0, n_pairs, 1, min(n_pairs, max(4 * cores, parts(n_pairs, PAIRS_A_TASK))))
    found = cut(tasks.mapInArrow(compare, "a long, b long, links long"))
    system, path = fs.FileSystem.from_uri(folder)
    system.delete_dir(path)  # nothing after the checkpoint reads the tiles
    # a repeated id with different values may stand for several classes: its links add up
    groups = components(found.select("a", "b")).join(found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links")), "node", "left")
    of = classes.drop("x").join(groups, F.col("rep") == F.col("node"), "left").select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    mine = hashed(rows.mapInArrow(plain, "vec_id long, v binary")).join(of, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")))
    return mine.select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"), (F.col("vec_id") == F.col("component")).alias("kept"))
