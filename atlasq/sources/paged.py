"""Reads of services that answer page by page, as rows. Pages follow each other, so one task reads them; what it keeps is one
page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: A page: its rows, and the key after which the next page begins (None behind the last one).
Page = tuple[list[dict], object | None]


def read(spark: SparkSession, fetch: Callable[[object | None], Page], schema: str, cap: int) -> DataFrame:
    """The rows of all pages with the columns of ``schema`` and ``truncated``: at most ``cap`` rows, and whether more was there.
    As the services do it, a key behind the last row that fits counts as more, even if its page would be empty."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            key, left, held = None, cap, []
            while True:
                rows, key = fetch(key)
                cut = len(rows) > left or (len(rows) == left and key is not None)
                held.append((rows[:left], cut))
                left -= min(left, len(rows))
                if cut or key is None:
                    break
            truncated = any(cut for _, cut in held)
            for rows, _ in held:
                if rows:
                    yield pd.DataFrame([[r.get(n) for n in names] + [truncated] for r in rows], columns=[*names, "truncated"])

    return spark.range(1, numPartitions=1).mapInPandas(pages, f"{schema}, truncated boolean")
