"""Give executors this package, wherever the driver has it from."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a session, once for each context, so that Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_lemmata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="lemmata-")), "lemmata.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path("lemmata") / p.relative_to(root))
    context.addPyFile(archive)
    context._lemmata_shipped = True


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task, often of another kind, else keeps the most
    that it ever needed, and all workers of an executor share its memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that has no such call
        pass


def lean(function):
    """``function`` over batches, which gives memory back after every few of them and at the end."""

    def run(batches):
        for n, batch in enumerate(function(batches)):
            yield batch
            del batch
            if n % 16 == 15:
                give_back()
        give_back()

    return run


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(lean(function), schema)
