"""Versions of fitted models in the shared folder.

A model's folder holds one sub-folder for each version and a log of events.
Both version numbers and events are claimed by creating a file that must not
exist yet, which the file system allows once, so two writers never get the
same number; nothing is ever changed or removed.  The stage of a version is
what the last event says.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from urllib.parse import urlparse

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

PRODUCTION, ARCHIVED, NONE = "production", "archived", "none"
EVENTS = "seq long, event string, version int, stage string, path string, metrics string, at double"


def _create_new(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with ``content``; False if it exists already."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parsed.path), exist_ok=True)
        draft = f"{os.path.dirname(parsed.path)}/.{uuid.uuid4().hex}"
        with open(draft, "w", encoding="utf-8") as f:
            f.write(content)
        try:
            os.link(draft, parsed.path)  # the whole file appears at once, or the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    try:
        out = fs.create(target, False)
    except Exception:  # noqa: BLE001 - the store says that the name is taken, or fails for good below
        if fs.exists(target):
            return False
        raise
    out.write(content.encode())
    out.close()
    return True


class ModelVersions:
    """Save, list, promote and load the versions of models under one root folder."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _claim(self, folder: str, content: dict) -> int:
        number = self._last(folder) + 1
        while not _create_new(self.spark, f"{folder}/{number:08d}.json", json.dumps({**content, "seq": number})):
            number += 1
        return number

    def _last(self, folder: str) -> int:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
        return max((int(n[:8]) for n in names if n[:8].isdigit()), default=0)

    def _log(self, name: str, **event) -> None:
        self._claim(f"{self.root}/{name}/events", {**event, "at": time.time()})

    def save(self, model: PipelineModel, name: str, metrics: dict | None = None) -> int:
        """Save ``model`` as the next version of ``name``; it is listed once it is whole."""
        version = self._claim(f"{self.root}/{name}/versions", {"by": uuid.uuid4().hex})
        path = f"{self.root}/{name}/v={version}"
        model.save(path)
        self._log(name, event="saved", version=version, stage=NONE, path=path, metrics=json.dumps(metrics or {}, sort_keys=True))
        return version

    def events(self, name: str) -> DataFrame:
        folder = f"{self.root}/{name}/events"
        if not self._last(folder):
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).json(folder).where("seq is not null")

    def list(self, name: str) -> DataFrame:
        """(version, stage, path, metrics): the saved versions with their latest stage."""
        log = self.events(name)
        last = Window.partitionBy("version").orderBy(F.desc("seq"))  # a handful of events a version
        stage = log.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("version", "stage")
        saved = log.where("event = 'saved'").select("version", "path", "metrics")
        return saved.join(stage, "version").select(F.lit(name).alias("name"), "version", "stage", "path", "metrics")

    def promote(self, name: str, version: int, stage: str = PRODUCTION) -> None:
        """Give ``version`` a stage; the version that had the stage before is archived."""
        listed = {r["version"]: r["stage"] for r in self.list(name).collect()}
        if version not in listed:
            raise ValueError(f"{name} has no version {version}")
        self._log(name, event="staged", version=version, stage=stage)
        for other, held in listed.items():
            if other != version and held == stage and stage not in (NONE, ARCHIVED):
                self._log(name, event="staged", version=other, stage=ARCHIVED)

    def latest(self, name: str, stage: str = PRODUCTION) -> int:
        """The version that was last given ``stage`` and still has it."""
        held = [r["version"] for r in self.list(name).where(F.col("stage") == stage).collect()]
        log = self.events(name).where((F.col("stage") == stage) & F.col("version").isin(held)).orderBy(F.desc("seq")).limit(1).collect()
        if not log:
            raise ValueError(f"{name} has no version in stage {stage}")
        return log[0]["version"]

    def load(self, name: str, version: int | None = None, stage: str = PRODUCTION) -> PipelineModel:
        """Load a version, by default the latest one in ``stage``."""
        return PipelineModel.load(f"{self.root}/{name}/v={self.latest(name, stage) if version is None else version}")
