"""A parquet table in key buckets, changed bucket by bucket, with versions for readers.

Rows lie in ``<path>/v=<version>/bucket=<b>``, with ``b`` from the hash of the
key. A change reads, combines and writes only the buckets its keys fall in; a
small manifest then names, for every bucket, the version that holds it. The
manifest is written last, so a reader sees a change whole or not at all, and a
reader of an earlier version keeps its files: they are removed when more
than ``keep`` manifests have followed. Versions are numbers given by the
caller (such as micro-batch ids): writing one again replaces its own files
and nothing else. There is one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path.rstrip("/"), key, buckets, max(1, keep)

    # -- files of the driver's side: a manifest has one short entry a bucket

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/manifest")
        if not fs.exists(where):
            return []
        names = (f.getPath().getName() for f in fs.listStatus(where))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def _manifest(self, version: int) -> dict:
        row = self.spark.read.text(f"{self.path}/manifest/{version}.json", wholetext=True).first()
        return json.loads(row[0])

    def _publish(self, version: int, manifest: dict) -> None:
        fs, where = self._fs(f"{self.path}/manifest/{version}.json")
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    # -- rows

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _files(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        held = {int(b): v for b, v in manifest["held"].items()}
        wanted = sorted(held if buckets is None else set(held) & set(buckets))
        schema = T.StructType.fromJson(manifest["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/v={held[b]}/bucket={b}" for b in wanted])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (default: the last one). Later changes leave what it reads alone while the version is kept."""
        versions = self.versions()
        if not versions or (version is not None and version not in versions):
            raise FileNotFoundError(f"no version {'' if version is None else version} of a table under {self.path}")
        return self._files(self._manifest(versions[-1] if version is None else version))

    def write(self, rows: DataFrame, version: int) -> None:
        """The whole table anew."""
        self._store(rows, version, {})

    def change(self, changes: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], version: int) -> list[int]:
        """Replace the buckets of the changes' keys by ``combine(their rows, changes)``; gives these buckets.

        ``changes`` is read more than once: pass a stored table, or one that gives the same rows every time.
        """
        before = [v for v in self.versions() if v < version]
        if not before:
            raise FileNotFoundError(f"no version before {version} of a table under {self.path}")
        manifest = self._manifest(before[-1])
        touched = sorted(r[0] for r in changes.select(self._bucket()).distinct().collect())  # at most ``buckets`` numbers
        if touched:
            current = self._files(manifest, touched)
            self._store(combine(current, changes).select(*current.columns), version, manifest["held"], touched)
        else:
            self._publish(version, manifest)
        return touched

    def _store(self, rows: DataFrame, version: int, held: dict, touched: list[int] | None = None) -> None:
        placed = rows.withColumn("bucket", self._bucket())
        base = f"{self.path}/v={version}"
        # one task a bucket group; a large bucket is split by AQE into several files
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(base)
        fs, where = self._fs(base)
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        written = {int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket=")}
        kept = {b: v for b, v in held.items() if touched is not None and int(b) not in touched}
        self._publish(version, {"schema": rows.schema.jsonValue(), "held": kept | {str(b): version for b in sorted(written)}})
        self._clean(version)

    def _clean(self, version: int) -> None:
        """Remove manifests beyond ``keep``, and the files that no kept one names."""
        versions = [v for v in self.versions() if v <= version]
        old, kept = versions[: -self.keep], versions[-self.keep :]
        named = {(int(b), v) for k in kept for b, v in self._manifest(k)["held"].items()}
        for v in old:
            for b, at in self._manifest(v)["held"].items():
                if (int(b), at) not in named:
                    fs, where = self._fs(f"{self.path}/v={at}/bucket={b}")
                    fs.delete(where, True)
            fs, where = self._fs(f"{self.path}/manifest/{v}.json")
            fs.delete(where, False)
