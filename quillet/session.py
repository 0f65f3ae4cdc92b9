"""Session helpers: shared-folder checkpoints and joins that stay balanced when one key is hot."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "quillet", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in spark.checkpoint.dir; make one only where it is unset and all runs in one
    process, as in tests. A machine's own folder is of no use to other machines, so elsewhere an unset folder fails."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = sc.getConf().get("spark.checkpoint.dir", "") or ""
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillet-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage with a reliable checkpoint in the shared folder."""
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def drop(df: DataFrame) -> None:
    """Delete the files of a frame that cut made, which nothing reads any more. Spark itself deletes them only when the driver
    happens to collect its garbage, so the frames of a loop would pile up on disk."""
    jsc = df.sparkSession.sparkContext._jsc
    files = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if files.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files.get())
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


#: At most this many keys can hold more than 1/HOT_SHARE of the rows each, so a table of them is safe to broadcast.
HOT_SHARE = 1000


def hot_threshold(rows: int, least: int = 20_000) -> int:
    """Rows from which a key counts as hot: above a thousandth of all rows, so at most 1,000 keys are hot."""
    return max(least, rows // HOT_SHARE)


def join_unique(left: DataFrame, right: DataFrame, key: str, weight: str, threshold: int, how: str = "inner") -> DataFrame:
    """Join left with right, whose key is unique and whose column `weight` counts the key's rows in left.

    Keys heavier than `threshold` (at most rows/threshold of them, see hot_threshold) are broadcast, so their rows
    never meet in one task; all others take one shuffle. The weight column is dropped. With how="left", rows of left
    without a partner are kept; a null key has no partner.
    """
    hot = F.broadcast(right.filter(F.col(weight) > threshold).drop(weight).withColumn("_hot", F.lit(True)))
    cold = right.filter(F.col(weight) <= threshold).drop(weight)
    tagged = left.join(hot, key, "left")
    mine = [c for c in right.columns if c not in (key, weight)]
    warm = tagged.filter(F.col("_hot")).drop("_hot")
    rest = tagged.filter(F.col("_hot").isNull()).drop("_hot", *mine).join(cold, key, how)
    return warm.unionByName(rest.select(*warm.columns))


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once per context, so that they need no installation."""
    sc = spark.sparkContext
    if getattr(sc, "_quillet_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="quillet-package-")) / "quillet.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("quillet") / p.relative_to(root))
    sc.addPyFile(str(target))
    sc._quillet_shipped = True
