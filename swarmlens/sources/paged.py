"""Cursor-paged scans: tables that are only given out a page at a time, after a cursor.

The table is planned as ranges of its key, which are paged side by side.  In a
range a page is asked for after the last row of the page before; the cursor is
the key and the row's own number, so that rows of one key are never lost
between two pages.  A page with fewer rows than asked for is the last.
The table should have an index on its key, as what is paged by a key has;
without one every page is a scan of the file.
"""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from swarmlens.sources.readers import _Sqlite

PAGE, MOST = 100, 2000  #: fixed values: rows of a page, and rows that the compatible mode stops at
TRIES, DELAY = 3, 2.0  #: fixed values: how often a page is asked for, and the first pause in seconds


class _Keys(InputPartition):
    """Rows of a file with ``low`` <= key < ``high``; None is open."""

    def __init__(self, path: str, low, high):
        self.path, self.low, self.high = path, low, high


class _PagedReader(_Sqlite, DataSourceReader):
    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.key, self.page, self.most = options["key"], int(options.get("page", PAGE)), int(options["most"]) if "most" in options else None
        self.keys, self.delay = max(1, int(options.get("rows", 100_000))), float(options.get("delay", DELAY))

    def partitions(self) -> list[_Keys]:
        if self.most is not None:  # one cursor over everything, as far as it goes
            return [_Keys(path, None, None) for path in self.files()[:1]] or [_Keys("", None, None)]
        parts = []
        for path in self.files():
            edges = [None, *self._edges(path), None]
            parts += [_Keys(path, low, high) for low, high in zip(edges[:-1], edges[1:])]
        return parts or [_Keys("", None, None)]

    def _edges(self, path: str) -> Iterator:
        """Keys that begin a range; each is looked for from the one before, so that the index is passed once."""
        found = self._run(path, f"SELECT {self.key} FROM {self.table} ORDER BY {self.key} LIMIT 1 OFFSET ?", [self.keys])
        if found and found[0][0] is None:  # the first range has all null keys
            found = self._run(path, f"SELECT min({self.key}) FROM {self.table}")
        while found and found[0][0] is not None:
            edge = found[0][0]
            yield edge
            found = self._run(path, f"SELECT {self.key} FROM {self.table} WHERE {self.key} >= ? ORDER BY {self.key} LIMIT 1 OFFSET ?", [edge, self.keys])
            if found and found[0][0] == edge:  # more rows of one key than a range has
                found = self._run(path, f"SELECT min({self.key}) FROM {self.table} WHERE {self.key} > ?", [edge])

    def fetch(self, part: _Keys, cursor: tuple | None) -> list[tuple]:
        """Up to a page of rows after ``cursor``: the columns wanted, then the cursor of each.  Null keys come first.

        First what is left of the cursor's own key, then greater keys: each enters the index where the page begins.
        """
        after, row = cursor or (None, None)
        same, equal = f"{self.key} IS NULL" if after is None else f"{self.key} = ?", [] if after is None else [after]
        if row is not None:
            same, equal = f"{same} AND rowid > ?", [*equal, row]
        more, args = f"{self.key} IS NOT NULL" if after is None else f"{self.key} > ?", [] if after is None else [after]
        if row is None and part.low is not None:
            same, equal, more, args = "0", [], f"{self.key} >= ?", [part.low]
        if part.high is not None:
            more, args = f"{more} AND {self.key} < ?", [*args, part.high]
        columns, place = f"SELECT {', '.join(self.names)}, {self.key}, rowid FROM {self.table}", len(self.names) + 1
        sql = f"SELECT * FROM ({columns} WHERE {same} ORDER BY rowid LIMIT ?) UNION ALL SELECT * FROM ({columns} WHERE {more} ORDER BY {self.key}, rowid LIMIT ?) ORDER BY {place}, {place + 1} LIMIT ?"
        args = [*equal, self.page, *args, self.page, self.page]
        for k in range(TRIES):
            try:
                return self._run(part.path, sql, args)
            except sqlite3.OperationalError:  # busy or out of reach
                if k == TRIES - 1:
                    raise
                time.sleep(self.delay * 2**k)
        return []

    def read(self, part: _Keys) -> Iterator[tuple]:
        cursor, given = None, 0
        while part.path:
            rows = self.fetch(part, cursor)
            for row in rows:
                if self.most is not None and given == self.most:
                    return
                given += 1
                yield tuple(None if v is None else str(v) if k == "string" else v for v, k in zip(row[:-2], self.kinds))
            if len(rows) < self.page:
                return
            if rows[-1][-2:] == cursor:
                raise ValueError("a page did not get past its cursor")
            cursor = rows[-1][-2:]


class PagedSource(DataSource):
    """Format ``paged_rows`` with options path, table, key, page, rows (of a range), most (compatible: one cursor, that many rows)."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "rowid bigint"

    def reader(self, schema):
        return _PagedReader(dict(self.options), schema)


def paged_rows(spark: SparkSession, path: str, table: str, key: str, schema: str, compat: bool = False, **options) -> DataFrame:
    """All rows of a table, by pages; ``compat`` stops at MOST rows of the first cursor."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged_rows").schema(schema).option("path", path).option("table", table).option("key", key).options(**options)
    return (reader.option("most", MOST) if compat else reader).load()
