"""A folder of named datasets, each in the native Parquet format with its own metadata."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from regionframe.model import Dataset, c
from regionframe.sources.readers import file_text, read_parquet
from regionframe.sources.writers import _put, profile, write_parquet, write_text


class Repository:
    """Datasets under ``root``, in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9_.-]*", name):
            raise ValueError(f"not a dataset name: {name!r}")
        return f"{self.root}/{name}"

    def _fs(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        path, fs = self._fs()
        return fs.exists(path(self._path(name) + "/regions"))

    def _need(self, name: str) -> str:
        if not self.exists(name):
            raise ValueError(f"no dataset {name}")
        return self._path(name)

    def create(self, name: str, ds: Dataset, info: dict[str, str] | None = None) -> None:
        if self.exists(name):
            raise ValueError(f"dataset {name} exists")
        write_parquet(ds, self._path(name))
        self.set_info(name, info or {})

    def list(self) -> list[str]:
        path, fs = self._fs()
        if not fs.exists(path(self.root)):
            return []
        return sorted(x.getPath().getName() for x in fs.listStatus(path(self.root)) if fs.exists(path(f"{self.root}/{x.getPath().getName()}/regions")))

    def load(self, name: str) -> Dataset:
        return read_parquet(self.spark, self._need(name), name)

    def delete(self, name: str) -> None:
        path, fs = self._fs()
        fs.delete(path(self._need(name)), True)

    def rename(self, old: str, new: str) -> None:
        path, fs = self._fs()
        if self.exists(new):
            raise ValueError(f"dataset {new} exists")
        fs.rename(path(self._need(old)), path(self._path(new)))

    def samples(self, name: str):
        """A frame of sample ids."""
        return self.load(name).meta.select("sample_id").distinct()

    def schema(self, name: str) -> list[tuple[str, str]]:
        ds = self.load(name)
        return [(a, ds.kind(a)) for a in ds.attributes]

    def meta(self, name: str, sample_id: int | None = None):
        meta = self.load(name).meta
        return meta if sample_id is None else meta.filter(F.col("sample_id") == sample_id)

    def add_samples(self, name: str, ds: Dataset) -> None:
        """Appends samples of the same attributes."""
        mine = self.load(name)
        if mine.attributes != ds.attributes:
            raise ValueError("the attributes differ")
        ds.regions.select(*[c(x) for x in mine.regions.columns]).write.mode("append").parquet(self._path(name) + "/regions")
        ds.meta.write.mode("append").parquet(self._path(name) + "/meta")

    def delete_sample(self, name: str, sample_id: int) -> None:
        """Rewrites the dataset beside the old one, then takes its place."""
        ds, info = self.load(name), self.info(name)
        rest = Dataset(ds.regions.filter(F.col("sample_id") != sample_id), ds.meta.filter(F.col("sample_id") != sample_id), name)
        fresh = f"{name}.new"
        write_parquet(rest, self._path(fresh))
        self.delete(name)
        self.rename(fresh, name)
        self.set_info(name, info)

    def export(self, name: str, path: str, kind: str = "tab") -> None:
        write_text(self.load(name), path, kind, name=name)

    def profile(self, name: str):
        return profile(self.load(name))

    def info(self, name: str) -> dict[str, str]:
        return json.loads(file_text(self.spark, self._need(name) + "/info.json"))

    def set_info(self, name: str, info: dict[str, str]) -> None:
        _put(self.spark, json.dumps(info), self._path(name) + "/info.json")
