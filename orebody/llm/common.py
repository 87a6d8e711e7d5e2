"""Shared pieces of the training-data operators: scratch tables, salted joins, text chunks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or, in local mode only, one of our own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="orebody-")
    return _own_dirs[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder as Parquet and read it back.

    Cuts the lineage so that a lost executor costs a re-read, not a recomputation.
    Files are removed when the Python process ends (or by `release`).
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/orebody-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remember(spark: SparkSession, path: str) -> None:
    """Have `path` deleted with the tables of `materialize`."""
    _written.append((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of `materialize` that nothing reads any more."""
    for t in tables:
        roots = {f.rsplit("/", 1)[0] for f in t.inputFiles()}
        for spark, path in [w for w in _written if any(r.endswith(w[1].rsplit("/", 1)[1]) for r in roots)]:
            _delete(spark, path)
            _written.remove((spark, path))


def release() -> None:
    """Delete every table that `materialize` wrote in this process."""
    while _written:
        try:
            _delete(*_written.pop())
        except Exception:  # the session is gone; nothing is left to delete with
            return


atexit.register(release)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salts: int = 16, by: list[str] | None = None) -> DataFrame:
    """Equi-join in which a key's rows of `big` are spread over `salts` tasks and `small` is repeated that often.

    For joins where one key may hold a third of `big` while `small` has few rows a key.
    `by`: columns of `big` that spread the rows (default: all that aren't keys). Only inner, left and left_semi.
    """
    own = by or [c for c in big.columns if c not in keys]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in own]), F.lit(salts)).cast("int") if own else F.lit(0)
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


SIEVE_BITS = 1 << 27  # 16 MB: what a sieve has at most, however many numbers it is made of


class Sieve:
    """A bitmap of hashed numbers, of bounded size: `places` is true for all that it was made of and for few others.

    Used before a shuffle, to leave out rows that the join would drop; the join stays exact. Where more numbers than bits go in,
    it lets more rows through and nothing else changes.
    """

    def __init__(self, numbers: DataFrame) -> None:
        name = numbers.columns[0]
        n = numbers.count()
        self.bits = 1 << min(SIEVE_BITS.bit_length() - 1, max(16, (16 * n).bit_length()))
        at = numbers.select((F.xxhash64(F.col(name)).bitwiseAND(F.lit(self.bits - 1))).alias("b"))
        words = at.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # bits / 64 rows at most
        self.words = np.zeros(self.bits // 64, np.int64)
        self.words[words.column("w").to_numpy()] = words.column("v").to_numpy()
        self.spark = numbers.sparkSession

    def shared(self):  # noqa: ANN201
        """The bitmap for use in tasks, with `places`."""
        return self.spark.sparkContext.broadcast(self.words)

    @staticmethod
    def places(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For Spark's xxhash64 of some numbers: whether the bitmap has them."""
        at = hashes & (len(words) * 64 - 1)
        return (words[at >> 6] >> (at & 63)) & 1 == 1


def sieved(df: DataFrame, key: str, sieve: Sieve, name: str = "_may") -> DataFrame:
    """`df` with a column that is false only where the key (a number; null: false) isn't among the sieve's."""
    shared = sieve.shared()
    hashed = df.withColumn("__at", F.when(F.col(f"`{key}`").isNotNull(), F.xxhash64(F.col(f"`{key}`").cast("long"))))
    schema = type(hashed.schema)(list(df.schema.fields)).add(name, "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            at = batch.column(batch.num_columns - 1)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            may = Sieve.places(at.fill_null(0).to_numpy(), words) & known
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(may)], schema.fieldNames())

    return hashed.mapInArrow(run, schema)


def without(df: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of `df` whose key isn't in `gone` (distinct numbers). Only rows that a sieve of `gone` holds are shuffled."""
    may = sieved(df, key, Sieve(gone), "__may")
    rest = may.filter("__may").join(gone, key, "left_anti").select(*[f"`{c}`" for c in df.columns])
    return may.filter("not __may").select(*[f"`{c}`" for c in df.columns]).union(rest)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts together stay near `limit` bytes (a longer text stands alone)."""
    n = batch.num_rows
    if not n:
        return
    if TaskContext.get() is not None:  # a worker, whose memory counts: the system's pool gives it back sooner than Arrow's own
        pa.set_memory_pool(pa.system_memory_pool())
    lengths = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
    start = total = 0
    for i, size in enumerate(lengths):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start, n - start)


def coded(part: pa.RecordBatch, text: str, lower: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of a chunk (as bytes; with A-Z lower-cased if asked for), the place of each token's word among them, and the
    tokens of each row. Words are parted by ASCII white space; null texts have none."""
    column = part.column(text)
    column = (column.view(pa.string()) if pa.types.is_binary(column.type) else column).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    words, ends = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    real = pc.not_equal(words, pa.scalar("", words.type)).to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
    before = np.concatenate([[0], np.cumsum(real)])
    encoded = words.filter(pa.array(real)).dictionary_encode()
    return encoded.dictionary.cast(pa.binary()), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(before[ends - ends[0]])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of each text; null becomes empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
