"""Files of source trees as rows: path, digest, text; configuration as flattened keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = ("**/*",), exclude: tuple[str, ...] = (), tests: bool = False) -> DataFrame:
    """(path, sha256, content) of files below root, paths relative to it; globs cross folders. The digest is computed where
    the file is read, and the content goes unread where it isn't selected downstream of a path filter."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.col("path"), "^[a-z]+:/{1,3}", "/")
    start = "/" + root.split("://")[-1].strip("/") + "/"
    path = F.substring_index(base, start, -1)
    rows = raw.select(path.alias("path"), F.sha2("content", 256).alias("sha256"), "content").where(~E.in_git_folder(F.col("path")))
    wanted = F.lit(False)
    for pattern in include:
        wanted = wanted | E.glob(F.col("path"), pattern)
    for pattern in exclude:
        wanted = wanted & ~E.glob(F.col("path"), pattern)
    return rows.where(wanted if tests else wanted & ~E.is_test_source(F.col("path")))


#: Fixed value: files that make a folder a build.
BUILD_FILE = r"(^|/)(pom\.xml|build\.gradle(\.kts)?|settings\.gradle(\.kts)?)$"


def build_roots(paths: DataFrame, depth: int = 5) -> DataFrame:
    """(root): the outermost build folders, ``depth`` below the scanned root at most; none where the root is a build itself, as
    then everything is scanned. An equi join of folders with their ancestors."""
    from ..operators.resolve import ancestors

    found = paths.where(F.col("path").rlike(BUILD_FILE) & ~E.in_git_folder(F.col("path"))).select(F.regexp_replace("path", "/?[^/]*$", "").alias("root")).distinct()
    whole = F.broadcast(found.agg(F.coalesce(F.bool_or(F.col("root") == ""), F.lit(False)).alias("whole")))  # one row
    near = found.crossJoin(whole).where(~F.col("whole") & (F.size(F.split("root", "/")) <= depth)).select("root")
    above = near.select("root", F.explode(ancestors(F.col("root"))).alias("above"))
    return near.join(above.join(near.select(F.col("root").alias("above")), "above", "left_semi").select("root").distinct(), "root", "left_anti")


def without_excluded(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Paths outside test, mock and archetype modules. modules: (folder, name)."""
    from ..operators.resolve import ancestors

    out = modules.where(E.is_excluded_module(F.col("folder"), F.col("name"))).select("folder").distinct()
    inside = paths.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(out, "folder", "left_semi").select("path").distinct()
    return paths.join(inside, "path", "left_anti")


def texts(files: DataFrame) -> DataFrame:
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def properties(texts: DataFrame) -> DataFrame:
    """(path, key, value) of .properties files: split at the first ``=`` or ``:``; comments and blanks go; of repeated keys the
    last counts."""
    lines = texts.where(F.col("path").endswith(".properties")).select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))
    lines = lines.where(~F.col("line").rlike(r"^\s*([#!].*)?$"))
    key, value = F.trim(F.regexp_extract("line", r"^\s*([^=:]+?)\s*[=:]", 1)), F.trim(F.regexp_extract("line", r"^[^=:]*[=:](.*)$", 1))
    return lines.where(F.col("line").rlike("[=:]")).groupBy("path", key.alias("key")).agg(F.max_by(value, "n").alias("value"))


def yaml_properties(texts: DataFrame) -> DataFrame:
    """The same of YAML files, with dotted keys; a file that doesn't parse gives no rows. YAML has no built-in reader, so files
    are parsed in Arrow batches."""

    def flat(prefix: str, value: object) -> Iterator[tuple[str, str | None]]:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from flat(f"{prefix}.{k}" if prefix else str(k), v)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                yield from flat(f"{prefix}[{i}]", v)
        else:
            yield prefix, None if value is None else str(value).lower() if isinstance(value, bool) else str(value)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["text"]):
                try:
                    for document in yaml.safe_load_all(text):
                        out += [(path, k, v) for k, v in flat("", document) if k]
                except yaml.YAMLError:
                    continue
            yield pd.DataFrame(out, columns=["path", "key", "value"])

    return texts.where(F.col("path").rlike(r"\.ya?ml$")).mapInPandas(parse, "path string, key string, value string")


def property_rank(path: Column) -> Column:
    """Order within a folder: application before bootstrap, yml, yaml, properties; profile files after the base ones."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    base = F.when(name.rlike(r"^application[.]"), 0).when(name.rlike(r"^bootstrap[.]"), 3).otherwise(6)
    return base + F.when(name.endswith(".yml"), 0).when(name.endswith(".yaml"), 1).otherwise(2)


#: Words by which a key shows what kind of value it wants; secrets anywhere in it, the others at its end.
SECRET_WORDS = ("password", "passwd", "secret", "token", "credential", "api[-_.]?key", "private[-_.]?key")
FLAG_WORDS = ("enable", "enabled", "ssl", "secure", "debug")
NUMBER_WORDS = ("port", "timeout", "retries", "count", "size", "interval", "duration")


def property_templates(texts: DataFrame) -> DataFrame:
    """(path, key, example): keys that code asks for; keys that look secret get a synthetic example."""
    found = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in (r"\$\{([A-Za-z0-9_.-]+)", r"get(?:Required)?Property\(\s*\"([^\"]+)\"", r"ConditionalOnProperty\((?:[^)]*?\b(?:name|value)\s*=\s*|\s*)\{?\s*\"([^\"]+)\"", r"ConfigurationProperties\(\s*(?:prefix\s*=\s*)?\"([^\"]+)\""))))
    rows = texts.select("path", F.explode(F.array_distinct(found)).alias("key"))
    low = F.lower("key")
    out = F.when(low.rlike("|".join(SECRET_WORDS)), "<secret>").when(low.rlike(f"({'|'.join(FLAG_WORDS)})$"), "false")
    return rows.withColumn("example", out.when(low.rlike(f"({'|'.join(NUMBER_WORDS)})$"), "0").otherwise("<string>"))
