"""Small helpers shared by the training-data operators.

Everything here is plain DataFrame code: reading tables through Spark, naming a
row by its own content, and cutting lineage into the shared checkpoint folder.
"""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockroom.plans.session import ensure_checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; ASCII texts (byte length = character length) take the fast built-in."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """128-bit digest naming a text; a null text has the empty text's digest with a mark of its own."""
    return F.when(text.isNull(), F.lit(b"null")).otherwise(F.unhex(F.md5(text)))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables beside the checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that :func:`shared_folder` named, once nothing reads it any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else, so that extra columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    The optimizer may inline a column into a lambda and so evaluate it once per element;
    a value bound as a lambda variable is evaluated once.
    """
    return F.transform(F.array(value), body)[0]


def worker_memory(name: str) -> dict:
    """A dict that lives as long as the Python worker, shared by the tasks it runs one after another."""
    holder = sys.modules.setdefault("_stockroom_worker_memory", types.ModuleType("_stockroom_worker_memory"))
    return holder.__dict__.setdefault(name, {})
