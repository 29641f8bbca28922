"""Lineage cuts between the passes of a long plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df``, written to the folder that ``spark.checkpoint.dir`` names and read from there.

    What follows starts from a plan of one node, and a lost executor costs no earlier pass.  A
    local folder is set only where Spark runs in one process; elsewhere the lack of a shared
    one is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt"))
    return df.checkpoint()
