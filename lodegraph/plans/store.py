"""The versioned store of world models: nodes and edges as Parquet, a manifest for each version.

base/source/version/model_id/{nodes,edges} and base/source/version/manifest. A manifest
row for each model holds its counts and metadata; a version's counts are the largest
among its models. All paths go through Hadoop's file system, so any store that
Spark can write to will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession



class WorldModelStore:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.jvm = spark._jvm

    def _path(self, *parts: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, *parts: str) -> list[str]:
        if not self._fs().exists(self._path(*parts)):
            return []
        return sorted(x.getPath().getName() for x in self._fs().listStatus(self._path(*parts)) if x.isDirectory())

    def save(self, nodes: DataFrame, edges: DataFrame, source: str, version: str, model_id: str, metadata: dict | None = None) -> dict:
        at = f"{self.base}/{source}/{version}/{model_id}"
        nodes.write.mode("overwrite").parquet(f"{at}/nodes")
        edges.write.mode("overwrite").parquet(f"{at}/edges")
        row = {"model_id": model_id, "nodes": self.spark.read.parquet(f"{at}/nodes").count(), "edges": self.spark.read.parquet(f"{at}/edges").count(), "metadata": metadata or {}}
        self.spark.createDataFrame([(json.dumps(row, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}/entry")
        return row

    def load(self, source: str, version: str, model_id: str) -> tuple[DataFrame, DataFrame]:
        if not self.exists(source, version, model_id):
            raise FileNotFoundError(f"{source}/{version}/{model_id}")
        at = f"{self.base}/{source}/{version}/{model_id}"
        return self.spark.read.parquet(f"{at}/nodes"), self.spark.read.parquet(f"{at}/edges")

    def exists(self, source: str, version: str, model_id: str) -> bool:
        return self._fs().exists(self._path(source, version, model_id, "entry"))

    def list_versions(self, source: str) -> list[str]:
        return self._list(source)

    def list_models(self, source: str, version: str) -> list[str]:
        return [m for m in self._list(source, version) if self.exists(source, version, m)]

    def manifest(self, source: str, version: str) -> dict:
        models = self.list_models(source, version)
        rows = [json.loads(self.spark.read.text(f"{self.base}/{source}/{version}/{m}/entry").first()[0]) for m in models]
        return {"source": source, "version": version, "models": models, "nodes": max((r["nodes"] for r in rows), default=0), "edges": max((r["edges"] for r in rows), default=0), "metadata": {r["model_id"]: r["metadata"] for r in rows}}

    def get_or_build(self, source: str, version: str, model_id: str, builder: Callable[[], tuple[DataFrame, DataFrame]], force: bool = False, metadata: dict | None = None) -> tuple[DataFrame, DataFrame]:
        """Loads the model, or builds it once and saves it."""
        if force or not self.exists(source, version, model_id):
            self.save(*builder(), source, version, model_id, metadata)
        return self.load(source, version, model_id)

    def delete_model(self, source: str, version: str, model_id: str) -> None:
        self._fs().delete(self._path(source, version, model_id), True)

    def delete_version(self, source: str, version: str) -> None:
        self._fs().delete(self._path(source, version), True)
