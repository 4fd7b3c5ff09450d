"""Ends of task logs as a table: `log_tail` reads each log under a folder from its end, in blocks, and its older part where that is short.

A log is a file name.log; what was rotated out of it is name.log.1. A line that begins no entry goes on with the entry
before it; if the part that is read begins with such lines, they are an entry without time and level. Messages come as
they are: `entries` masks what is secret in them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tilespan.functions import text
from tilespan.sources.geotiff import _opened

#: The levels that count as errors, and how an entry begins.
ERROR_LEVELS = ("WARNING", "ERROR", "CRITICAL")
ENTRY = re.compile(r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)?)\s+([A-Z]+)\s+(.*)")
BLOCK = 64 << 10
_SCHEMA = "log string, place int, time string, level string, message string"


def last_lines(read: Callable[[int, int], bytes], size: int, want: int, block: int = BLOCK) -> list[str]:
    """The last whole lines of a file, `want` at most, oldest first; read(offset, length). Bytes that are no text are replaced.

    One line break more than lines is looked for: the line that a block begins in is not whole.
    """
    parts, at, breaks = [], size, 0
    while at and breaks <= want:
        n = min(block, at)
        at -= n
        parts.append(read(at, n))
        breaks += parts[-1].count(b"\n")
    lines = b"".join(reversed(parts)).decode("utf-8", errors="replace").splitlines()
    return (lines[1:] if at else lines)[-want:] if want > 0 else []


def folded(lines: list[str]) -> list[tuple[str | None, str | None, str]]:
    """time, level, message of the entries that lines make."""
    out: list[tuple[str | None, str | None, str]] = []
    for line in lines:
        begun = ENTRY.fullmatch(line)
        if begun:
            out.append(begun.groups())
        elif out:
            out[-1] = (*out[-1][:2], f"{out[-1][2]}\n{line}")
        else:
            out.append((None, None, line))
    return out


class _Logs(InputPartition):
    def __init__(self, logs: list[tuple[str, int, int]]):
        self.logs = logs


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.limit, self.block, self.per_task = int(options.get("limit", 500)), int(options.get("block", BLOCK)), int(options.get("logsPerTask", 64))
        self.errors = options.get("errorsOnly", "false").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        system, at = _opened(self.path)
        prefix = self.path[: self.path.index(at)] if at in self.path else ""
        sizes = {prefix + f.path: f.size for f in system.get_file_info(fs.FileSelector(at, recursive=True)) if f.type == fs.FileType.File}
        names = sorted({p.removesuffix(".1") for p in sizes if p.endswith((".log", ".log.1"))})
        logs = [(p, sizes.get(p, 0), sizes.get(f"{p}.1", 0)) for p in names]
        return [_Logs(logs[k : k + self.per_task]) for k in range(0, len(logs), self.per_task)] or [_Logs([])]

    def _tail(self, path: str, size: int, want: int) -> list[str]:
        if not size or want <= 0:
            return []
        system, at = _opened(path)
        try:
            with system.open_input_file(at) as f:
                return last_lines(lambda offset, n: f.read_at(n, offset), size, want, self.block)
        except OSError:  # rotated away or removed since it was listed
            return []

    def read(self, partition: _Logs) -> Iterator[tuple]:
        for path, size, older in partition.logs:
            lines = self._tail(path, size, self.limit)
            lines = self._tail(f"{path}.1", older, self.limit - len(lines)) + lines
            name = path[len(self.path) :].lstrip("/").removesuffix(".log")
            for place, (time, level, message) in enumerate(folded(lines)):
                if not self.errors or level in ERROR_LEVELS:
                    yield name, place, time, level, message


class LogTails(DataSource):
    """format("log_tail").options(limit=lines, errorsOnly=bool).load(folder): the last entries of each log under the folder."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogTails)


def entries(spark: SparkSession, folder: str, limit: int = 500, errors_only: bool = False) -> DataFrame:
    """log, place, time, level and masked message of each log's last lines."""
    register(spark)
    rows = spark.read.format("log_tail").options(limit=max(1, limit), errorsOnly=str(errors_only).lower()).load(folder)
    return rows.withColumn("message", text.redact(F.col("message")))


def diagnostics(tails: DataFrame, facts: dict[str, str]) -> DataFrame:
    """log, report: a text to send on: what is known of the surroundings, then the log's entries."""
    said = F.trim(F.concat_ws(" ", "time", "level", "message"))
    gathered = tails.groupBy("log").agg(F.array_sort(F.collect_list(F.struct("place", said.alias("said")))).alias("rows"))
    head = [text.redact(F.lit(f"{k}: {v}")) for k, v in facts.items()]
    return gathered.select("log", F.concat_ws("\n", *head, F.concat(F.lit("log: "), F.col("log")), F.lit(""), F.array_join(F.transform("rows", lambda r: r.said), "\n"), F.lit("")).alias("report"))
