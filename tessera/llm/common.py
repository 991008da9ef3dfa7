"""What the operators of this subpackage share: text conventions, shared storage and skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D, nothing else.
WS = " \t\n\x0b\x0c\r"
WS_BYTES = WS.encode()
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Table for bytes.translate: A-Z to a-z, all other bytes alone, so UTF-8 stays valid.
LOWER_TABLE = bytes.maketrans(_UPPER.encode(), _LOWER.encode())
#: A key that holds this share of the rows or more counts as hot; there are at most 1000 such keys.
HOT_SHARE = 1000
#: Other keys are split where they have more rows than one task takes (narrow rows; rows with whole texts or pages), and never more
#: than this many keys are listed for it: beyond, a task takes more rows.
TASK_ROWS, WIDE_ROWS, SPLIT_KEYS = 1_000_000, 20_000, 100_000


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


_rng = np.random.RandomState(7)
#: A random odd number for each byte, and the base of the polynomial with its inverse modulo 2**64.
_OF_BYTE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_WS = np.zeros(256, bool)
_IS_WS[list(WS_BYTES)] = True
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _BACK = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(table: np.ndarray, base: int, at: np.ndarray) -> np.ndarray:
    """base ** at modulo 2**64."""
    if not len(at) or at[-1] <= _BLOCK:
        return table[at]
    high = _powers(pow(base, _BLOCK, 1 << 64), int(at[-1]) // _BLOCK)
    return high[at // _BLOCK] * table[at % _BLOCK]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of data (lower-cased already): differences of a running polynomial sum."""
    b = np.frombuffer(data, np.uint8)
    word = np.concatenate([[False], ~_IS_WS[b], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    power = 1
    for i in range(0, len(b), _BLOCK):  # by blocks, as each byte takes several words of memory meanwhile
        part = _OF_BYTE[b[i : i + _BLOCK]]
        part *= _POWERS[: len(part)]
        part *= np.uint64(power)
        part[:1] += sums[i : i + 1]
        np.cumsum(part, out=sums[i + 1 : i + 1 + len(part)])
        power = power * pow(_BASE, _BLOCK, 1 << 64) % (1 << 64)
    return starts, ends, mix((sums[ends] - sums[starts]) * _power(_BACK, _INVERSE, starts) + (ends - starts).astype(np.uint64))


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_TABLE)


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """names, with underscores before each that is taken (Spark's names ignore case)."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def packed(docs: DataFrame, *apart: str) -> DataFrame:
    """The columns apart, then all others as one struct, row, so that nothing can clash with them; unpacked() undoes it."""
    rest = [c for c in docs.columns if c not in apart]
    row = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.struct(F.lit(None).cast("int").alias("c0"))
    return docs.select(*apart, row.alias("row"))


def unpacked(columns: list[str], *apart: str) -> list[Column]:
    """The columns of the table that packed() got, in their order."""
    rest = {c: i for i, c in enumerate(c for c in columns if c not in apart)}
    return [F.col(c) if c in apart else F.col(f"row.c{rest[c]}").alias(c) for c in columns]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; set here only where the session has none and runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _storage(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


_folders: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, which goes when the application ends."""
    path = f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"
    if path not in _folders:
        files, at = _storage(spark, path)
        files.mkdirs(at)
        files.deleteOnExit(at)
        _folders.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_written", None):
            files, at = _storage(df.sparkSession, path)
            files.delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int = TASK_ROWS) -> DataFrame:
    """Left join on one key column against a table with at most one row a key, whose weight column counts
    the left rows of that key.

    Keys with a thousandth of all rows or more (so at most 1000 of them, whatever the data) are broadcast; only
    the rows of other keys are shuffled, and of these a key with more rows than a task takes is split: its left rows are dealt over
    parts, its right row is repeated for each. The weight column does not come back. right should be materialised. Columns of right
    must not have names of left's; the names used within can't clash with either's.
    """
    hot, part, parts = fresh([*left.columns, *right.columns], "hot", "part", "parts")
    total = right.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE >= F.lit(total)
    values = [c for c in right.columns if c not in (key, weight)]
    known = right.filter(is_hot).select(key, *values, F.lit(True).alias(hot))
    tried = left.join(F.broadcast(known), key, "left")
    cold = right.filter(~is_hot)
    most = cold.agg(F.max(weight)).first()[0]
    if most is None:
        return tried.drop(hot)
    found = tried.filter(F.col(hot).isNotNull()).drop(hot)
    rest = tried.filter(F.col(hot).isNull()).select(*map(quoted, left.columns))
    rows = max(rows, total // SPLIT_KEYS)
    if most <= rows:
        rest = rest.join(cold.select(key, *values), key, "left")
    else:
        n = F.ceil(F.col(weight) / F.lit(rows)).cast("int")
        large = F.broadcast(cold.filter(F.col(weight) > rows).select(key, n.alias(parts)))  # SPLIT_KEYS at most
        dealt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col(parts).cast("long")), F.lit(0)).cast("int")
        rest = rest.join(large, key, "left").withColumn(part, dealt).drop(parts)
        copies = cold.select(key, *values, F.explode(F.sequence(F.lit(0), n - 1)).alias(part))
        rest = rest.join(copies, [key, part], "left").drop(part)
    return found.unionByName(rest.select(*map(quoted, found.columns)))
