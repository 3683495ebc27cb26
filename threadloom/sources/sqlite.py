"""A Spark data source for tables of a SQLite store, read in parallel by ranges of rowid.

spark.dataSource.register(SqliteSource); spark.read.format("sqlite").option("path", file).option("table", name).load()
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Columns of the store's tables.
TABLES = {
    "project": "id string, worktree string, time_updated bigint",
    "session": "id string, project_id string, parent_id string, directory string, title string, time_created bigint, time_updated bigint",
    "message": "id string, session_id string, time_created bigint, data string",
    "part": "id string, session_id string, message_id string, time_created bigint, data string",
}


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))
        self.first, self.last = first, last


class SqliteSource(DataSource):
    """Options: path, table (one of ``TABLES`` unless a schema is given), partitions (8)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return TABLES[self.options["table"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], schema.fieldNames(), int(self.options.get("partitions", "8")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[str], most: int):
        if not table.isidentifier():
            raise ValueError(f"no table name: {table}")
        self.path, self.table, self.columns, self.most = path, table, columns, max(1, most)

    def _connect(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._connect() as db:
            low, high = db.execute(f"select min(rowid), max(rowid) from {self.table}").fetchone()
        if low is None:
            return []
        step = -(-(high - low + 1) // self.most)
        return [_Range(a, min(a + step - 1, high)) for a in range(low, high + 1, step)]

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # an empty table has no ranges
            return
        names = ", ".join('"' + c.replace('"', "") + '"' for c in self.columns)
        with self._connect() as db:
            yield from db.execute(f"select {names} from {self.table} where rowid between ? and ?", (partition.first, partition.last))
