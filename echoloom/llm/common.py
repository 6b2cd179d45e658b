"""What the training-data operators share: keys, words, settled tables and checked joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: What separates runs of digits, a-z and everything beyond ASCII, once A-Z are lower-cased.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ASCII white space.
SPACE_RUN = r"[\x20\x09-\x0D]+"

#: A relation of at most so many rows, and of so many bytes by its statistics (Parquet files in the shared folder),
#: may be broadcast; join_checked looks at both first.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of our own serves local sessions alone (tests, bench); on a cluster a missing setting is an error, as
    what executors wrote to their own disks would be lost without notice.
    """
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = os.path.join(tempfile.gettempdir(), "echoloom-shared")
    return place.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    Cuts the lineage: a lost executor costs the running stage alone, and what follows reads a table whose
    content and order are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of settled tables. For those that only tables settled since were made of: nothing reads them again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a settled relation may be broadcast: its size as Parquet by the plan's statistics, and its rows, counted."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= size and df.limit(rows + 1).count() <= rows


def join_checked(big: DataFrame, small: DataFrame, on, how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join to a settled relation: broadcast after a check of its rows and bytes, else by shuffle (skewed keys are split by AQE)."""
    if is_small(small, rows):
        return big.join(F.broadcast(small), on, how)
    return big.join(small.hint("merge"), on, how)


def join_shuffled(big: DataFrame, small: DataFrame, on, how: str) -> DataFrame:
    """Join to a relation that grows with the corpus: by shuffle at every size (skewed keys are split by AQE)."""
    return big.join(small.hint("merge"), on, how)


def unclashed(df: DataFrame, *names: str) -> None:
    """Raise where a table already has a column that an operator is about to add."""
    taken = [n for n in names if n.lower() in {c.lower() for c in df.columns}]
    if taken:
        raise ValueError(f"the table already has the columns {taken}, which this operator adds: rename them first")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Pure ASCII takes the fast path, as lower() would change other letters."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def alnum_words(text: Column) -> Column:
    # Split, as extracting all matches copies the whole text for each of them.
    return F.array_remove(F.split(ascii_lower(whole(text)), NOT_ALNUM), "")


def solid_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.array_remove(F.split(ascii_lower(whole(text)), SPACE_RUN), "")


def row_key(*cols: Column) -> Column:
    """A 128-bit key of a row's id and text. Rows that agree in both are the same row to every operator."""
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in cols]
    return F.unhex(F.md5(F.concat(*parts).cast("binary")))


def at(array: Column, index: Column) -> Column:
    """array[index], zero-based, null outside."""
    return F.get(array, index)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
