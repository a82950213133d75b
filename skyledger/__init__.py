"""Alert-catalog analytics as Spark jobs: every operator is ``f(df, ...) -> DataFrame``."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Send this package to the executors (as ``spark-submit --py-files`` would), once a session."""
    context = spark.sparkContext
    if getattr(context, "_skyledger_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="skyledger-ship-")) / "skyledger.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, os.path.join("skyledger", path.relative_to(root)))
    context.addPyFile(str(archive))
    context._skyledger_shipped = True
