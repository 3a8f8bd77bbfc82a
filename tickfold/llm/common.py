"""Helpers that the operators of this package share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters only: other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word: ASCII letters and digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Maps the bytes of UTF-8 text so that words are lower-cased and all else is a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; on a cluster it is an error, as a
    machine-local folder would lose data there.
    """
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir():
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and a lost
    executor costs nothing that was computed before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which a user sets in proportion to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


#: Rows that go to a Python worker at once; the session's default of 10,000 long texts would fill its memory.
BATCH_ROWS = 1_000


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of ``df``, for kernels; from here on the session sends texts in small batches."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def small_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


class Cache(dict):
    """Values of recent keys, in two generations of at most ``most`` keys: what is used again stays."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (value := self.old.pop(key, None)) is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text) -> F.col:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id, by: int):
    """crc32 of the id as text, modulo ``by``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, list[pa.RecordBatch]]]:
    """Runs of equal ``key`` in batches that are sorted by it, one run at a time."""
    run, have = None, []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if have and keys[start] != run:
                yield run, have
                have = []
            run = keys[start]
            have.append(batch.slice(start, i - start))
            start = i
    if have:
        yield run, have


#: Rows of a written table that may be broadcast; longer ones are joined by shuffle.
MOST_BROADCAST_ROWS = 200_000


def sized(df: DataFrame, most: int = MOST_BROADCAST_ROWS) -> DataFrame:
    """``df`` as a written table, marked for broadcast if it has ``most`` rows at most."""
    df = written(df)
    return F.broadcast(df) if df.count() <= most else df
