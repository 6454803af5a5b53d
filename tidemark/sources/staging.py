"""Cuts in the lineage that survive lost executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def staged(rows: DataFrame) -> DataFrame:
    """``rows`` computed once and kept in the folder of ``spark.checkpoint.dir``; a local session without one gets a
    temporary folder, a cluster without one is an error, since executors would not see it."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return rows.checkpoint()
