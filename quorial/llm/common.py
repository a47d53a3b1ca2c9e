"""Helpers shared by the text operators."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (as in tests) a
    temporary folder takes its place; a cluster without it is refused, as executors
    would not see each other's files.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quorial-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends here,
    and an executor lost later costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quorial/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*tables: DataFrame) -> None:
    """Deletes ``stored`` tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join whose sides are both shuffled and sorted.

    Spark judges a stored table by the size of its compressed files, not by its rows, and
    less by the rows that an explode makes of them, so without this it may send a table
    that grows with the input through the driver's memory as a broadcast."""
    return df.hint("merge")


def position(df: DataFrame, name: str) -> int:
    """Where a column is.  A name that fits exactly wins over one that differs in case."""
    names = df.columns
    near = [i for i, c in enumerate(names) if c == name] or [i for i, c in enumerate(names) if c.lower() == name.lower()]
    if not near:
        raise ValueError(f"no column {name!r} in {names}")
    return near[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same columns as ``c0, c1, ...``, so that none is ambiguous."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other
    columns of the input can't clash with them."""
    return numbered(df).select(*[F.col(f"c{position(df, given)}").alias(own) for own, given in columns.items()])


def text_digest(text: F.Column) -> F.Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class Cache(dict):
    """A dict of things learned that can be learned again.  ``trim`` empties it once its
    keys and values take more than about ``most`` bytes."""

    def __init__(self, most: int = 40 << 20):
        super().__init__()
        self.most, self.held = most, 0

    def learn(self, keys: list, values: list, more: int = 0) -> None:
        self.update(zip(keys, values, strict=True))
        self.held += sum(map(len, keys)) + (120 + more) * len(keys)

    def trim(self) -> None:
        if self.held > self.most:
            self.drop()

    def drop(self) -> None:
        self.clear()
        self.held = 0


#: Bytes of a batch that Spark sends to a Python worker, about.
BATCH = 4 << 20


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, *, most: int = 3 << 20, text_at: int = 1) -> DataFrame:
    """``df.mapInArrow`` of ``tidy(run)``, with Spark's batches bounded by bytes.

    By default Spark gathers 64 MB for a batch, in buffers outside the heap that double
    as they grow and whose pools stay with the executor, and the worker holds the batch
    once more.  The bound is lowered in the session, as plans read it when they run; a
    lower one stays."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))
    return df.mapInArrow(tidy(run, most=most, text_at=text_at), schema)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *, most: int = 3 << 20, text_at: int = 1):
    """``run`` for ``mapInArrow``, given batches of about ``most`` bytes of text, after
    which the worker gives back the memory that it no longer needs: workers are used
    again by later stages, which would otherwise add theirs to it."""
    user = f"{run.__module__}.{run.__qualname__}"

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, rows in runs_of(b.column(text_at), most):
                yield b.slice(start, rows)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(user)
        try:
            yield from run(small(batches))
        finally:
            give_back()

    return wrapped


#: What workers keep between batches, emptied when a task ends.
_CACHES: list[weakref.ref] = []


def kept(cache: Cache) -> Cache:
    _CACHES.append(weakref.ref(cache))
    return cache


#: What a worker has built for the tasks of one function, by key, and that function.
_BUILT: dict = {}
_USER: list[str] = [""]


def begin(user: str) -> None:
    """Drops what was built for the tasks of another function."""
    if _USER[0] != user:
        _USER[0] = user
        if _BUILT:
            _BUILT.clear()
            give_back()


def built(key, make: Callable):
    """``make()``, once for all tasks of a function that a worker has one after another;
    a worker holds one such thing at a time."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = make()
    return _BUILT[key]


def give_back() -> None:
    """Empties the caches of this process and returns free memory to the system."""
    for ref in _CACHES:
        if (cache := ref()) is not None:
            cache.drop()
    _CACHES[:] = [ref for ref in _CACHES if ref() is not None]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def runs_of(column: pa.Array, most: int = 3 << 20) -> list[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes: where each begins, and its rows."""
    if not len(column):
        return []
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // most)) + 1
    return [(int(a), int(b - a)) for a, b in zip([0, *cuts], [*cuts, len(column)], strict=True)]


def slices(column: pa.Array, most: int = 3 << 20) -> list[pa.Array]:
    """The column without nulls, cut into runs of rows of about ``most`` bytes."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return [column.slice(a, n) for a, n in runs_of(column, most)]


def distinct_pieces(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of a list array: where each row's pieces begin (and end), the number of each
    piece, and the different pieces."""
    starts = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    return starts - starts[0], coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values)]
    return total[starts[1:]] - total[starts[:-1]]


def gather(blob: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges ``first .. first + size`` of ``blob``, one after another."""
    has = size > 0
    first, size = first[has], size[has]
    if not len(first):
        return blob[:0]
    ends = np.cumsum(size)
    step = np.ones(int(ends[-1]), np.int64)
    step[0] = first[0]
    step[ends[:-1]] = first[1:] - (first[:-1] + size[:-1] - 1)
    return blob[np.cumsum(step)]


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


#: Bytes that separate words: ASCII other than digits and letters; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def ascii_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z
    lower-cased, as UTF-8.  Bytes over 0x7F only occur in characters over U+007F,
    which all belong to words."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _S33)
        x = x * _MIX1
        x = x ^ (x >> _S33)
        x = x * _MIX2
        return x ^ (x >> _S33)


#: A 64-bit number for each byte of a word (0 for what separates words), and its place's weight.
_LONGEST = 48
_BYTES = np.random.default_rng(20231101).integers(0, 2**64, 256, np.uint64) * (np.frombuffer(_FOLD, np.uint8) != 32)
_WEIGHTS = np.cumprod(np.full(_LONGEST, 0x9E3779B97F4A7C15, np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (see ``ascii_words``) of all texts, one after another,
    and where those of each text begin (and end)."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(parts).translate(_FOLD)
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[0, (data != 32).view(np.int8), 0]))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    offsets = np.cumsum([0, *[len(p) + 1 for p in parts]])
    starts = np.searchsorted(begin, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), starts
    place = np.arange(begin[0], len(data), dtype=np.int32) - np.repeat(begin, np.diff(np.r_[begin, len(data)])).astype(np.int32)
    with np.errstate(over="ignore"):
        value = _BYTES[data[begin[0] :]]
        value *= _WEIGHTS[np.minimum(place, _LONGEST - 1)]
        out = mix64(np.add.reduceat(value, begin - begin[0]) + size.astype(np.uint64))
    for i in np.flatnonzero(size > _LONGEST).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : begin[i] + size[i]], digest_size=8).digest(), "little")
    return out, starts
