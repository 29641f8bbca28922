"""Shared helpers of the training-data operators: lineage cuts and byte-level text kernels.

The kernels work on the UTF-8 buffer of an Arrow string column.  White space, digits and
ASCII letters are single bytes in UTF-8 and never occur inside another character, so word
boundaries found on bytes are those of the text.
"""

from __future__ import annotations

import json
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3
#: Bytes of text handled at a time, so that the work arrays stay in the CPU's cache.
CHUNK = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``, or the one already set in the session.

    A folder of one's own is made only where Spark runs in one process; elsewhere its lack is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder in whatever store its path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as an expression of the plan, without a Python worker."""
    names = [c.split()[0] for c in schema.split(", ")]
    data = json.dumps([dict(zip(names, r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")))


def bounded_sample(rows: DataFrame, keys: list[str], most_rows: int, most_bytes: int):
    """Rows (keys, text) on the driver, distinct by ``keys``, in the order of a hash of the keys.

    At most ``most_rows`` of them and ``most_bytes`` of text; where a key has several texts, one of them.
    A text of more than a 64th of the bytes is not sampled, so that it can't take the place of all others.
    """
    rows = rows.filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes // 64).groupBy(*keys).agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("__h", F.xxhash64(F.lit(5), *keys))
    rows = cut(rows)
    sizes = rows.select("__h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")).orderBy("__h").limit(most_rows).collect()
    fits = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), most_bytes, "right"))
    last = sizes[fits - 1]["__h"] if fits else None
    return rows.filter(F.col("__h") <= F.lit(last).cast("long")).orderBy("__h", *keys).limit(most_rows).drop("__h").toPandas()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(off: np.ndarray, most: int = CHUNK):
    """Ranges of rows of about ``most`` bytes; a longer text is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            a = np.full(size, U(_BASE))
            b = np.full(size, U(pow(_BASE, -1, 1 << 64)))
            a[0] = b[0] = 1
            _POW[:] = [np.cumprod(a), np.cumprod(b)]
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def word_bounds(buf: np.ndarray, off: np.ndarray, sep: np.ndarray = SPACE):
    """Starts and ends of the words of a range of texts, and the first word of each text."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~sep[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word
    end = np.append(word[:-1] & (~word[1:] | edge[1:n]), word[-1])
    ws = np.flatnonzero(start)
    return ws, np.flatnonzero(end) + 1, np.searchsorted(ws, off)


def word_hashes(low: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs [ws, we) of ``low``."""
    n = len(low)
    if not len(ws):
        return np.zeros(0, U)
    pw, inv = _powers(n + 1)
    with np.errstate(over="ignore"):
        c = np.empty(n + 1, U)
        c[0] = 0
        np.cumsum((low.astype(U) + U(1)) * pw[:n], out=c[1:])
        return mix((c[we] - c[ws]) * inv[ws] + (we - ws).astype(U) * GOLD)


def fold_upper(buf: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters of UTF-8 bytes in lower case."""
    low = LOWER[buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) + 1
    if len(lead):
        b = low[lead]
        low[lead] = np.where((b >= 0x80) & (b <= 0x9E) & (b != 0x97), b + 32, b)
    return low
