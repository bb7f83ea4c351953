"""What the operators share: cutting lineage, word splitting, 64-bit mixing."""

from __future__ import annotations

import gc
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the space, and tab to carriage return.
BLANKS = b" \t\n\r\x0b\x0c"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, one of our own, but only on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tessera-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder.

    Partitioning and row order inside a partition are kept, and lost executors
    only cause a re-read of the files.
    """
    shared_folder(df.sparkSession)
    done = df.checkpoint(eager=True)
    gc.collect()  # what earlier steps shuffled goes from the disks as soon as nothing refers to it
    df.sparkSession.sparkContext._jvm.System.gc()
    return done


def let_go(*frames: DataFrame) -> None:
    """Deletes the files of ``cut`` frames that nothing reads any more."""
    for df in frames:
        plan = df._jdf.queryExecution().logical()
        file = plan.rdd().getCheckpointFile() if plan.nodeName() == "LogicalRDD" else None
        if file is not None and file.isDefined():
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(taken, *names: str) -> list[str]:
    """``names``, each with underscores added until no column of ``taken`` has it, in any case of its letters."""
    taken, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def crc_mod(column: str, modulus: int = 5) -> Column:
    """crc32 of the column as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
