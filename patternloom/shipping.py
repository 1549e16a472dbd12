"""Making the package importable by Python workers, wherever they run."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's sources along with the tasks of this Spark context, once."""
    sc, root = spark.sparkContext, Path(__file__).resolve().parent
    if getattr(sc, "_patternloom_shipped", False) or not root.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="patternloom-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/patternloom_src.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._patternloom_shipped = True
