"""Session helpers: table access, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Blanks that may surround an id: every white-space or invisible character.
BLANKS = r"[\s\p{Z}\x{200B}-\x{200F}\x{FEFF}]"


#: Setting that deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, unless their PYTHONPATH has it; once per application."""
    root, application = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if application in _shipped or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _shipped.add(application)
    target = Path(tempfile.mkdtemp(prefix="tamis-code-")) / "tamis.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.glob("tamis/**/*.py")):
            archive.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(target))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A table of a directory of Parquet tables."""
    ship_code(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def clean_id(c: Column | str) -> Column:
    """The id without surrounding blanks (tabs included); null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", ""), F.lit(""))


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder comes from spark.checkpoint.dir, which all executors share.
    Only where that is unset (tests on one machine) a folder of its own is made.
    The shuffle files behind the checkpoint are deleted with its end, not only when the driver collects its garbage.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tamis-checkpoint-")
        context.setCheckpointDir(folder)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # the setting counts for a new plan
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
