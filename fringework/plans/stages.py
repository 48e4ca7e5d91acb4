"""Persisted stages: a table and a sidecar with the parameters it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import PurePath

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class StageError(RuntimeError):
    """A stage holds something else than was asked for."""


def _plain(value: object) -> object:
    if isinstance(value, PurePath):
        return str(value)
    return value.item() if hasattr(value, "item") else str(value)


def hash_params(params: dict) -> str:
    return hashlib.sha256(json.dumps(params, sort_keys=True, default=_plain).encode()).hexdigest()


class Workspace:
    """A folder of stages, each a Parquet table with ``<name>.json`` beside it; both may be on any file system that arrow and Spark read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        uri = self.root if "://" in self.root else f"file://{self.root}"
        self.files, self.base = pyarrow.fs.FileSystem.from_uri(uri)
        self.files.create_dir(self.base, recursive=True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}.parquet"

    def _side(self, name: str) -> str:
        return f"{self.base}/{name}.json"

    def _read(self, name: str) -> dict | None:
        if self.files.get_file_info(self._side(name)).type == pyarrow.fs.FileType.NotFound:
            return None
        with self.files.open_input_stream(self._side(name)) as f:
            return json.loads(f.read())

    def _write(self, name: str, told: dict) -> None:
        draft = f"{self._side(name)}.draft"
        with self.files.open_output_stream(draft) as f:
            f.write(json.dumps(told, sort_keys=True, default=_plain).encode())
        self.files.move(draft, self._side(name))

    def exists(self, name: str) -> bool:
        return self._read(name) is not None

    def stored_params_hash(self, name: str) -> str | None:
        return (self._read(name) or {}).get("params_hash")

    def has(self, name: str, params: dict) -> bool:
        return self.stored_params_hash(name) == hash_params(params)

    def clear(self, name: str) -> None:
        """The sidecar goes first, so a stage without one is never half deleted."""
        if self.exists(name):
            self.files.delete_file(self._side(name))
        for folder in (f"{self.base}/{name}.parquet", f"{self.base}/{name}.done"):
            if self.files.get_file_info(folder).type != pyarrow.fs.FileType.NotFound:
                self.files.delete_dir(folder)

    def store(self, name: str, df: DataFrame | Callable[[], DataFrame], params: dict, overwrite: bool = False, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """The stage, made only if it is not there with the same parameters.

        Other parameters are an error unless ``overwrite``; a table is never
        overwritten by one that still reads it.
        """
        known = self.stored_params_hash(name)
        if known == hash_params(params):
            return self.load(name)
        if known is not None and not overwrite:
            raise StageError(f"stage {name!r} was made from other parameters")
        made = df() if callable(df) else df
        if known is not None and any(f"/{name}.parquet/" in f for f in made.inputFiles()):
            raise StageError(f"stage {name!r} is read by what would replace it")
        self.clear(name)
        made.write.partitionBy(*partition_by).parquet(self.path(name))
        self._write(name, {"params": params, "params_hash": hash_params(params), "columns": made.columns})
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        told = self._read(name)
        if told is None:
            raise StageError(f"there is no stage {name!r}")
        if "by" not in told:
            return self.spark.read.parquet(self.path(name)).select(*told["columns"])
        # Only slices that were finished count.
        schema = StructType.fromJson(json.loads(told["schema"]))
        done = [f"{self.path(name)}/slice={p}" for p in sorted(self.pairs_done(name))]
        return self.spark.read.schema(schema).parquet(*done) if done else self.spark.createDataFrame([], schema)

    def init(self, name: str, like: DataFrame, params: dict, by: str = "pair", overwrite: bool = False) -> None:
        """A stage whose slices are written one by one: its columns and parameters are known before any of its rows.

        What is there from the same parameters stays, so a run that was cut off goes
        on; other parameters are an error unless ``overwrite``.
        """
        known = self.stored_params_hash(name)
        if known == hash_params(params):
            return
        if known is not None and not overwrite:
            raise StageError(f"stage {name!r} was made from other parameters")
        self.clear(name)
        like.limit(0).write.mode("overwrite").parquet(self.path(name))
        self._write(name, {"params": params, "params_hash": hash_params(params), "columns": like.columns, "by": by, "schema": like.schema.json()})

    def write_region(self, name: str, df: DataFrame, slice_: int) -> None:
        """One slice's rows, in a folder of their own: writers of different slices share no file, and a slice that is written again is replaced alone."""
        told = self._read(name)
        if told is None or "by" not in told:
            raise StageError(f"stage {name!r} is not set up to be written by slice")
        df.select(*told["columns"]).write.mode("overwrite").parquet(f"{self.path(name)}/slice={int(slice_)}")
        self.mark_done(name, slice_)

    def mark_done(self, name: str, pair: int) -> None:
        """Progress of a stage that is made pair by pair: a marker for each, so writers never share a file."""
        self.files.create_dir(f"{self.base}/{name}.done", recursive=True)
        with self.files.open_output_stream(f"{self.base}/{name}.done/{int(pair)}") as f:
            f.write(b"")

    def pairs_done(self, name: str) -> set[int]:
        found = self.files.get_file_info(pyarrow.fs.FileSelector(f"{self.base}/{name}.done", allow_not_found=True))
        return {int(f.base_name) for f in found}
