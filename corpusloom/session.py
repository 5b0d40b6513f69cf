"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "corpusloom", master: str | None = None, **conf) -> SparkSession:
    """Session for tests and benches; on a cluster the submitter's session is used as is."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: `spark.checkpoint.dir`, or a temporary one in local mode."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        if not context.getCheckpointDir():
            context.setCheckpointDir(shared)
        return shared.rstrip("/")
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    context.setCheckpointDir(folder)
    return folder


def new_run_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the work folder."""
    return os.path.join(work_dir(spark), f"{label}-{uuid.uuid4().hex[:12]}")


def stable(df):
    """Cut lineage with a reliable checkpoint, so partition ids and row positions cannot change."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)
