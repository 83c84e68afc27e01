"""Shared helpers of the training-data operators: tables in the shared folder, sizes, null-safe keys."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes may be broadcast; beyond it the shuffled way is taken.
BROADCAST_BYTES = 32 << 20

#: White space that separates words: ``[\\x20\\x09-\\x0D]``.
WORD = r"[^\x20\x09-\x0D]+"

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where none is set, a local session gets a temporary one of its own; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="deckloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def staged(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs the reread of a file, not the work before it, and every later use sees
    the same rows. ``release`` (also run at exit) removes the tables.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.option("compression", codec).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_path = path
    return back


def restaged(df: DataFrame, old: DataFrame) -> DataFrame:
    """Stage ``df`` in place of ``old``, a staged table that nothing else reads from here on: it is removed."""
    done = staged(df)
    _made[:] = [m for m in _made if m[1] != old.staged_path or not _remove(*m)]
    return done


def _remove(spark: SparkSession, path: str) -> bool:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    except Exception:  # the session may be gone at exit; files in the shared folder are then its owner's to clean
        return False
    return True


def release() -> None:
    """Remove all staged tables of this process; one that can't be removed doesn't keep the others."""
    while _made:
        _remove(*_made.pop())


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Removes at its end the tables staged inside, but for those passed to what it yields."""
    before, kept = len(_made), set()

    def keep(df: DataFrame) -> DataFrame:
        """Stage ``df`` and keep that table."""
        done = staged(df)
        kept.add(_made[-1][1])
        return done

    yield keep
    inside = _made[before:]
    _made[before:] = [m for m in inside if m[1] in kept or not _remove(*m)]


atexit.register(release)


#: Rows go to Python workers in batches of about so many bytes, whatever their number.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes: a worker holds a few batches, however long the texts are.

    The bound is a setting of the session (``spark.sql.execution.arrow.maxBytesPerBatch``); a lower one that is set already stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(conf.get(name, str((1 << 31) - 1)).removesuffix("b")) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    if any(set(c) & set(".`") for c in df.columns):  # mapInArrow looks its columns up by name and reads dots as fields
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return df.mapInArrow(run, schema)


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """Names for internal columns that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        name = f"_deckloom_{name}"
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def typed(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns as items of a schema string."""
    return [f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in columns]


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_if_small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast if the (staged) table is counted to fit; else leave the join to adaptive execution."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


#: More things than this that share half of their hash can't come from a sound hash at any size: n things have about n^2 / 2^65.
TWINS_MAX = 1 << 16


def twins(pairs: DataFrame, taken: DataFrame) -> list[tuple[int, int, int]]:
    """(id, check, new id) for all but one of the things (id, check: two halves of 128 bits) that share an id.

    ``pairs``: the distinct things whose id is shared; ``taken`` (id): all ids in use. The new ids are 64 bits of both halves, drawn again until no
    one else has them, so ids that are told apart are exact at any number of things.
    """
    first = pairs.groupBy(F.col("id").alias("_id")).agg(F.min("check").alias("_first"))
    rest = pairs.join(first, F.col("id") == F.col("_id")).where(F.col("check") != F.col("_first")).select("id", "check").distinct()
    found = [(r["id"], r["check"]) for r in rest.limit(TWINS_MAX + 1).collect()]
    if len(found) > TWINS_MAX:
        raise ValueError(f"over {TWINS_MAX} things share half of their hash with another")
    for attempt in range(64):
        new = [int.from_bytes(hashlib.blake2b(struct.pack("<qqi", i, c, attempt), digest_size=8).digest(), "little", signed=True) for i, c in found]
        used = len(set(new)) < len(new) or not taken.where(F.col("id").isin(new) if len(new) < 1000 else F.array_contains(F.lit(new), F.col("id"))).isEmpty()
        if not used:
            return [(i, c, n) for (i, c), n in zip(found, new, strict=True)]
    raise ValueError("no free ids were found")


def split_hot(counts: DataFrame, n: str, limit: int) -> tuple[DataFrame, DataFrame | None]:
    """A staged table of keys with their numbers of rows, as the most frequent keys, at most ``limit``, and the rest (None if there is none).

    Keys of more than total / limit rows are hot: there can't be more than ``limit`` of them, whatever the size of the input, and what
    is left of a key is at most that share of all rows.
    """
    size = counts.agg(F.count(F.lit(1)).alias("keys"), F.sum(n).alias("total")).first()
    if size["keys"] <= limit:
        return counts, None
    least = size["total"] // limit if limit else size["total"]
    return counts.where(F.col(n) > least), counts.where(F.col(n) <= least)


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(col(text) if isinstance(text, str) else text, F.lit(""))


def hash_bits(*cols: Column, seed: int = 0) -> Column:
    """64 hash bits of the values; another ``seed`` gives independent bits."""
    return F.xxhash64(F.lit(seed), *cols)
