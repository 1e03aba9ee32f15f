"""Versioned snapshots of fact tables: a reader sees one complete version, the old or the new one.

A version's tables are Parquet below ``root/v<number>``; the file ``root/CURRENT`` names the version and is renamed into
place last, through Spark's own file system layer, so any store that it reaches will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: what readers of this layout understand.
SCHEMA_VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def current(spark: SparkSession, root: str) -> dict | None:
    """The published version's description, or None."""
    fs, path, _ = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(path):
        return None
    found = json.loads("".join(r["value"] for r in spark.read.text(f"{root}/CURRENT").collect()))
    if found["schema"] != SCHEMA_VERSION:
        raise ValueError(f"snapshot schema {found['schema']}, expected {SCHEMA_VERSION}")
    return found


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], meta: dict[str, str] | None = None) -> int:
    """Writes all tables as a new version, then makes it the current one; an error before that leaves the old one."""
    before = current(spark, root)
    version = (before["version"] if before else 0) + 1
    place = f"v{version}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/{place}/{name}")
    body = json.dumps({"schema": SCHEMA_VERSION, "version": version, "place": place, "tables": sorted(tables), "meta": meta or {}})
    fs, target, jvm = _fs(spark, f"{root}/CURRENT")
    fresh = jvm.org.apache.hadoop.fs.Path(f"{root}/.next-{uuid.uuid4().hex}")
    out = fs.create(fresh, True)
    out.write(bytearray(body.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(target), options)
    return version


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table of the current version; the reader stays on it whatever is published later."""
    found = current(spark, root)
    if found is None or table not in found["tables"]:
        raise FileNotFoundError(f"{root} has no published table {table}")
    return spark.read.parquet(f"{root}/{found['place']}/{table}")


def federation(spark: SparkSession, roots: dict[str, str], table: str) -> tuple[dict[str, DataFrame], list[str]]:
    """The table of every root that has it, and a warning for each that has not."""
    found, warnings = {}, []
    for service, root in sorted(roots.items()):
        try:
            found[service] = read(spark, root, table)
        except (FileNotFoundError, ValueError) as e:
            warnings.append(f"{service}: {e}")
    return found, warnings
