"""Page tables as a stream whose offset is a page's id: a source for Spark's Python data source API.

``spark.dataSource.register(Pages)``, then ``spark.readStream.format("sidewind_pages").option("path", folder)``.
A batch holds the pages after the last offset, in as many ranges of ids as there are ``partitions``; each range is
read by its own task, by the id column's statistics. Spark keeps the offset in the query's checkpoint, so
a restart reads only later pages. Ids must grow: a page with an id below the offset that comes later is not seen.

The tasks read the files by themselves, so the path must be one that all machines see (a shared folder, or
a store that pyarrow reads).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

COLUMNS = ("page_id", "url", "html")


class Range(InputPartition):
    def __init__(self, low: int, high: int):
        """Ids above low, up to high."""
        self.low, self.high = low, high


def _dataset(path: str):
    import pyarrow.dataset as ds

    return ds.dataset(path.removeprefix("file:"), format="parquet", exclude_invalid_files=False)


def _rows(path: str, part: Range) -> Iterator:
    import pyarrow.dataset as ds

    at = ds.field("page_id")
    for batch in _dataset(path).to_batches(columns=list(COLUMNS), filter=(at > part.low) & (at <= part.high), batch_size=1000):
        if batch.num_rows:
            yield batch


def _newest(path: str) -> int:
    """The greatest id; only the id column is read, in batches."""
    import pyarrow.compute as pc

    return max((m for b in _dataset(path).to_batches(columns=["page_id"]) if (m := pc.max(b.column(0)).as_py()) is not None), default=-1)


def ranges(low: int, high: int, n: int) -> list[Range]:
    cuts = [low + (high - low) * i // n for i in range(n + 1)]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class _Batch(DataSourceReader):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n

    def partitions(self) -> list[Range]:
        return ranges(-1, _newest(self.path), self.n) or [Range(-1, -1)]

    def read(self, partition: Range) -> Iterator:
        return _rows(self.path, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n

    def initialOffset(self) -> dict:
        return {"page_id": -1}

    def latestOffset(self) -> dict:
        return {"page_id": _newest(self.path)}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(start["page_id"], end["page_id"], self.n) or [Range(-1, -1)]

    def read(self, partition: Range) -> Iterator:
        return _rows(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sidewind_pages"

    def schema(self) -> str:
        return "page_id long, url string, html string"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options["path"], int(self.options.get("partitions", "8")))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("partitions", "8")))


def register(spark: SparkSession) -> None:
    """The source goes by value: the workers that plan and read it need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(Pages)
