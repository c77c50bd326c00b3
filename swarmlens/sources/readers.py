"""Readers of documents, logs, platform databases and profiles."""

from __future__ import annotations

import json
import os
import sqlite3
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

ACTION_SCHEMA = "round INT, timestamp STRING, agent_id BIGINT, agent_name STRING, action_type STRING, action_args MAP<STRING, STRING>, result STRING, success BOOLEAN, platform STRING, event_type STRING, _bad STRING"
TEXT_SUFFIXES = ("pdf", "md", "markdown", "txt")


def decoded(data: bytes) -> str:
    """Text of a file: UTF-8, else the encoding that charset-normalizer finds, else UTF-8 with replacement."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    try:
        from charset_normalizer import from_bytes

        best = from_bytes(data).best()
        if best is not None:
            return str(best)
    except ImportError:
        pass
    return data.decode("utf-8", errors="replace")


def pdf_text(data: bytes) -> str:
    """Text of a PDF's pages that have some, a blank line between; needs PyMuPDF."""
    try:
        import fitz
    except ImportError as e:
        raise ImportError("reading PDF files needs PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as pages:
        return "\n\n".join(t for t in (p.get_text() for p in pages) if t.strip())


def documents(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text, error) of the files: an unknown suffix or a broken file gives an error instead of a text."""
    files = spark.read.format("binaryFile").load(glob).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                suffix = path.rpartition(".")[2].lower()
                try:
                    if suffix not in TEXT_SUFFIXES:
                        raise ValueError(f"unsupported file type: {suffix}")
                    out.append((path, pdf_text(content) if suffix == "pdf" else decoded(content), None))
                except Exception as e:  # one bad file is a row with an error, not a failed job
                    out.append((path, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return files.mapInPandas(run, "path string, text string, error string")


def joined_documents(docs: DataFrame) -> DataFrame:
    """One row: all documents by path, each under a numbered header; a failed one leaves a note."""
    numbered = docs.agg(F.array_sort(F.collect_list(F.struct("path", F.coalesce("text", F.concat(F.lit("[could not be read: "), "error", F.lit("]"))).alias("body")))).alias("d"))
    part = F.transform("d", lambda x, i: F.concat(F.lit("=== Document "), (i + 1).cast("string"), F.lit(": "), F.element_at(F.split(x["path"], "/"), -1), F.lit(" ===\n"), x["body"]))
    return numbered.select(F.array_join(part, "\n\n").alias("text"))


def action_log(spark: SparkSession, glob: str, platform: str | None = None, agent_id: int | None = None, round: int | None = None) -> DataFrame:
    """Actions of JSON-lines logs: without blank and torn lines, control events and rows without an agent.

    The platform is the record's own or the name of its folder.
    """
    rows = spark.read.schema(ACTION_SCHEMA).option("columnNameOfCorruptRecord", "_bad").json(glob)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/=]+)/[^/]*$", 1)
    rows = rows.withColumn("platform", F.coalesce(F.nullif("platform", F.lit("")), folder))
    rows = rows.where("_bad is null and event_type is null and agent_id is not null").drop("_bad", "event_type")
    for name, value in (("platform", platform), ("agent_id", agent_id), ("round", round)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows


def control_events(spark: SparkSession, glob: str) -> DataFrame:
    rows = spark.read.schema("event_type STRING, round INT, timestamp STRING, simulated_hour INT, actions_count INT, total_rounds INT, total_actions INT, platform STRING").json(glob)
    return rows.where("event_type is not null")


def log_lines(spark: SparkSession, path: str, from_line: int = 0) -> DataFrame:
    """(line, value) of one log file from a line (0 is the first) on.

    The file is read in blocks; a block's first line has the number of lines
    in the blocks before it.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    rows = rows.select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))  # a row for each block
    starts = sizes.select("block", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1
    lines = rows.withColumn("place", place).join(starts, "block").select((F.col("place") + F.col("start")).alias("line"), "value")
    return lines.where(F.col("line") >= from_line)


def agent_log(spark: SparkSession, path: str, from_line: int = 0) -> DataFrame:
    """(line, value) of the lines that hold a JSON object."""
    return log_lines(spark, path, from_line).where(F.col("value").rlike(r"^\s*\{") & F.try_parse_json("value").isNotNull())


def report_log(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, line, action, section_index, elapsed, details as JSON text) of the records of reports; torn lines are left out."""
    schema = "report_id BIGINT, line BIGINT, action STRING, section_index INT, elapsed_seconds DOUBLE, details MAP<STRING, STRING>, _bad STRING"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_bad").json(folder).where("_bad is null and action is not null")
    return rows.select("report_id", "line", "action", "section_index", F.col("elapsed_seconds").alias("elapsed"), F.to_json("details").alias("details"))


def latest_progress(spark: SparkSession, folder: str) -> DataFrame:
    """(report_id, status, progress, message, current_section): the last progress record of each report."""
    rows = spark.read.schema("report_id BIGINT, line BIGINT, status STRING, progress INT, message STRING, current_section INT").json(folder).where("report_id is not null")
    last = rows.groupBy("report_id").agg(F.max_by(F.struct("status", "progress", "message", "current_section"), "line").alias("p"))
    return last.select("report_id", "p.*")


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """(section_index, content) of section_NN files, or folders as the sink writes them, in order."""
    rows = spark.read.text(f"{folder}/section[_=]*", wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return rows.select(F.regexp_extract("path", r"section_(\d+)", 1).cast("int").alias("section_index"), F.col("value").alias("content")).orderBy("section_index")


def profiles(spark: SparkSession, json_path: str | None, csv_path: str | None, lines: bool = False) -> DataFrame:
    """Profiles of the JSON file (one array, or a folder of JSON lines), or of the CSV with its columns renamed."""
    if json_path is not None:
        return spark.read.option("multiLine", not lines).json(json_path)
    rows = spark.read.option("header", True).csv(csv_path)
    return rows.select("user_id", "username", F.col("name").alias("realname"), F.col("description").alias("bio"), F.col("user_char").alias("persona"), F.lit("unknown").alias("profession"))


def listing(spark: SparkSession, glob: str, newest: str | None = None, limit: int | None = None, **equal) -> DataFrame:
    """State files of many runs, projects or reports as rows, newest first if asked for."""
    rows = spark.read.option("multiLine", True).json(glob)
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if newest is not None:
        rows = rows.orderBy(F.desc(newest))
    return rows if limit is None else rows.limit(limit)


def config_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per config file: agents, initial posts, topics, and which platform configs it names (null values too)."""
    text = spark.read.text(path, wholetext=True).select("value")
    count = lambda p: F.coalesce(F.json_array_length(F.get_json_object("value", p)), F.lit(0))
    has = lambda k: F.array_contains(F.json_object_keys("value"), k)
    return text.select(
        count("$.agent_configs").alias("n_agents"), count("$.event_config.initial_posts").alias("n_posts"), count("$.event_config.hot_topics").alias("n_topics"),
        has("twitter_config").alias("has_twitter_config"), has("reddit_config").alias("has_reddit_config"),
    )


def next_command(spark: SparkSession, folder: str) -> DataFrame:
    """(path, command): the oldest JSON file of a folder that can be parsed, if there is one."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.json")
    text = F.col("content").cast("string")
    return files.where(F.try_parse_json(text).isNotNull()).orderBy("modificationTime", "path").limit(1).select("path", text.alias("command"))


def page_with_retry(fetch, tries: int = 3, delay: float = 2.0, sleep=time.sleep):
    """What ``fetch()`` gives; after a connection, time-out or system error it is asked again, each time after twice the delay."""
    for k in range(tries):
        try:
            return fetch()
        except OSError:  # connection and time-out errors are among them
            if k == tries - 1:
                raise
            sleep(delay * 2**k)


class _Range(InputPartition):
    """Rows of one file from rowid ``low`` to ``high``."""

    def __init__(self, path: str, low: int, high: int):
        self.path, self.low, self.high = path, low, high


class _Sqlite:
    """A table that stands in one database file, or in every ``*.db`` of a folder."""

    def __init__(self, options: dict, schema):
        self.path, self.table, self.names = options["path"].removeprefix("file://"), options["table"], [f.name for f in schema]
        self.kinds = [f.dataType.typeName() for f in schema]
        self.rows = max(1, int(options.get("rows", 100_000)))
        self.conditions: list[tuple[str, list]] = []

    def files(self) -> list[str]:
        if os.path.isdir(self.path):
            return sorted(f"{self.path}/{name}" for name in os.listdir(self.path) if name.endswith(".db"))
        return [self.path] if os.path.exists(self.path) else []

    def _run(self, path: str, sql: str, args: list = ()) -> list:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            if con.execute("SELECT 1 FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (self.table,)).fetchone() is None:
                return []
            return con.execute(sql, args).fetchall()
        finally:
            con.close()

    def last(self, path: str) -> int:
        """The greatest rowid, or -1."""
        found = self._run(path, f"SELECT max(rowid) FROM {self.table}")
        return found[0][0] if found and found[0][0] is not None else -1

    def ranges(self, path: str, after: int, upto: int | None = None) -> list[_Range]:
        found = self._run(path, f"SELECT min(rowid), max(rowid) FROM {self.table} WHERE rowid > ? AND rowid <= ?", [after, upto if upto is not None else 2**63 - 1])
        if not found or found[0][0] is None:
            return []
        low, high = found[0]
        return [_Range(path, k, min(high, k + self.rows - 1)) for k in range(low, high + 1, self.rows)]

    def read(self, part: _Range):
        where = "".join(f" AND {sql}" for sql, _ in self.conditions)
        sql = f"SELECT {', '.join(self.names)} FROM {self.table} WHERE rowid BETWEEN ? AND ?{where} ORDER BY rowid"
        for row in self._run(part.path, sql, [part.low, part.high, *(v for _, values in self.conditions for v in values)]):
            yield tuple(None if v is None else str(v) if k == "string" else v for v, k in zip(row, self.kinds))


class _SqliteReader(_Sqlite, DataSourceReader):
    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.after = int(options.get("after", -1))

    def pushFilters(self, filters):
        """Comparisons with a value become conditions of the query inside the database.

        Spark checks strings again, since a database may hold other kinds of values in such a column.
        """
        for f in filters:
            pushed = _condition(f, dict(zip(self.names, self.kinds)))
            if pushed is not None:
                self.conditions.append(pushed)
            if pushed is None or any(isinstance(v, str) for v in pushed[1]):
                yield f

    def partitions(self):
        return [part for path in self.files() for part in self.ranges(path, self.after)] or [_Range("", 0, -1)]

    def read(self, partition):
        return super().read(partition) if partition.path else iter(())


def _condition(f, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL over one column and its values, which holds wherever the filter does."""
    signs = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in kinds:
        return None
    if isinstance(f, IsNotNull):
        return f"{name} IS NOT NULL", []
    values = list(f.value) if isinstance(f, In) else [f.value] if type(f) in signs else []
    text = kinds[name] == "string"
    if not values or not all(type(v) is (str if text else int) for v in values) or not (text or kinds[name] in ("long", "integer")):
        return None
    sql = f"{name} IN ({', '.join('?' * len(values))})" if isinstance(f, In) else f"{name} {signs[type(f)]} ?"
    return (f"(typeof({name}) <> 'text' OR {sql})" if text else sql), values


class _SqliteChanges(_Sqlite, DataSourceStreamReader):
    """Offsets are the rowid that each file has been read up to.

    With ``most`` an epoch has that many rowids of a file at most.  What has
    been planned last is then noted in the folder ``progress`` before an epoch
    is read; Spark plans an epoch that was not finished again before it asks
    for more, so after a restart the note is where the checkpoint is.
    """

    def __init__(self, options: dict, schema):
        super().__init__(options, schema)
        self.most = int(options["most"]) if "most" in options else None
        self.note = options["progress"].removeprefix("file://") + "/planned.json" if self.most else None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last = {path: end for path in self.files() if (end := self.last(path)) >= 0}
        if not self.most:
            return last
        planned = self._planned()
        return planned | {path: max(planned.get(path, -1), min(end, planned.get(path, self._first(path)) + self.most)) for path, end in last.items()}

    def _first(self, path: str) -> int:
        """The place before the first rowid."""
        return self._run(path, f"SELECT min(rowid) FROM {self.table}")[0][0] - 1

    def _planned(self) -> dict:
        if not os.path.exists(self.note):
            return {}
        with open(self.note) as note:
            return json.load(note)

    def partitions(self, start: dict, end: dict) -> list:
        if any(end.get(path, -1) < at for path, at in start.items() if path in end):
            raise ValueError("the noted progress is behind the checkpoint")
        if self.note:
            os.makedirs(os.path.dirname(self.note), exist_ok=True)
            with open(self.note + ".new", "w") as note:
                json.dump(end, note)
            os.replace(self.note + ".new", self.note)
        return [part for path, upto in sorted(end.items()) for part in self.ranges(path, start.get(path, -1), upto)]

    def commit(self, end: dict) -> None:
        pass


class SqliteSource(DataSource):
    """Format ``sqlite_rows`` with options path (a database or a folder of ``*.db``), table and a schema of the columns wanted.

    Tables are read in ranges of rowid; a missing file or table has no rows.
    Batches take ``after`` (rowid); streams read what is appended, with
    ``most`` rowids of a file an epoch and then a ``progress`` folder.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "rowid bigint"

    def reader(self, schema):
        return _SqliteReader(dict(self.options), schema)

    def streamReader(self, schema):
        return _SqliteChanges(dict(self.options), schema)


def sqlite_rows(spark: SparkSession, path: str, table: str, schema: str, after: int = -1) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").schema(schema).option("path", path).option("table", table).option("after", after).load()


def sqlite_changes(spark: SparkSession, path: str, table: str, schema: str, **options) -> DataFrame:
    """A stream of the rows that are in the tables and are appended to them."""
    spark.dataSource.register(SqliteSource)
    return spark.readStream.format("sqlite_rows").schema(schema).option("path", path).option("table", table).options(**options).load()


TRACE_ROWS = "rowid bigint, user_id bigint, action string, info string, created_at string"


def as_actions(rows: DataFrame) -> DataFrame:
    """Actions of rows of a trace: ignored kinds left out, known arguments kept, kinds renamed."""
    from swarmlens.functions import rules

    args = F.coalesce(F.from_json("info", "map<string, string>"), F.create_map().cast("map<string, string>"))
    rows = rows.where(~F.col("action").isin(*rules.IGNORED_ACTIONS))
    return rows.select("rowid", F.col("user_id").alias("agent_id"), rules.standard_action("action").alias("action_type"), rules.kept_args(args).alias("action_args"), "created_at")


def new_actions(spark: SparkSession, path: str, after: int = -1) -> DataFrame:
    """Actions of the trace table past a rowid."""
    return as_actions(sqlite_rows(spark, path, "trace", TRACE_ROWS, after))


def interview_rows(spark: SparkSession, path: str, user_id: int | None = None, limit: int = 100) -> DataFrame:
    """Newest interviews of the trace table: prompt and response, or the whole info where there is none."""
    rows = sqlite_rows(spark, path, "trace", TRACE_ROWS).where("action = 'interview'")
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    response = F.coalesce(F.get_json_object("info", "$.response"), F.col("info"))
    return rows.orderBy(F.desc("created_at"), F.desc("rowid")).limit(limit).select("user_id", F.get_json_object("info", "$.prompt").alias("prompt"), response.alias("response"), "created_at")


def platform_posts(spark: SparkSession, path: str, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = sqlite_rows(spark, path, "post", "post_id bigint, user_id bigint, content string, created_at string")
    return rows.orderBy(F.desc("created_at"), F.desc("post_id")).offset(offset).limit(limit)


def platform_comments(spark: SparkSession, path: str, post_id: int | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    rows = sqlite_rows(spark, path, "comment", "comment_id bigint, post_id bigint, user_id bigint, content string, created_at string")
    if post_id is not None:
        rows = rows.where(F.col("post_id") == post_id)
    return rows.orderBy(F.desc("created_at"), F.desc("comment_id")).offset(offset).limit(limit)


def last_positions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")
