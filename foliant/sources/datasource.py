"""Spark data sources in Python: paged clients as readable tables, and a sink whose failed attempts leave nothing."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as Ds
from pyspark.sql.types import StructType

#: Comparisons that a client can be asked for.
COMPARISONS = {Ds.EqualTo: "=", Ds.GreaterThan: ">", Ds.GreaterThanOrEqual: ">=", Ds.LessThan: "<", Ds.LessThanOrEqual: "<=", Ds.In: "in"}


class Client(Protocol):
    """What a paged data set offers. It is made anew wherever it is needed, from the options of the read."""

    #: Schema as a DDL string, and columns whose comparisons the client itself can apply.
    schema: str
    filterable: tuple[str, ...]

    def pages(self) -> int: ...

    def page(self, number: int, filters: list[tuple[str, str, Any]]) -> pa.RecordBatch | pa.Table:
        """Rows of a page that pass (column, comparison, value); may raise, and is then asked again."""


class _Range(Ds.InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class _Reader(Ds.DataSourceReader):
    """Partitions are ranges of pages. A page that fails is asked for again after a pause that doubles."""

    def __init__(self, make: Callable[[dict], Client], options: dict):
        self.make, self.options, self.filters = make, options, []

    def pushFilters(self, filters: list[Ds.Filter]):  # noqa: N802
        own = self.make(self.options).filterable
        for f in filters:
            sign = COMPARISONS.get(type(f))
            if sign and len(f.attribute) == 1 and f.attribute[0] in own and f.value is not None:
                self.filters.append((f.attribute[0], sign, f.value))
            else:
                yield f  # Spark applies it

    def partitions(self) -> list[_Range]:
        n, size = self.make(self.options).pages(), int(self.options.get("pagesperpartition", 1))
        return [_Range(i, min(n, i + size)) for i in range(0, n, size)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        client, tries, pause = self.make(self.options), int(self.options.get("tries", 4)), float(self.options.get("pause", 0.5))
        for number in range(partition.first, partition.last):
            for attempt in range(tries):
                try:
                    found = client.page(number, self.filters)
                    break
                except Exception:
                    if attempt == tries - 1:
                        raise
                    time.sleep(pause * 2**attempt)
            yield from found.to_batches() if isinstance(found, pa.Table) else [found]


def register_paged(spark: SparkSession, name: str, make: Callable[[dict], Client]) -> None:
    """From now on spark.read.format(name).options(...).load() reads what make(options) offers, page by page in many tasks.

    Comparisons with constants on columns that the client can filter go to it, for which the session's setting of such filters is turned on. Options:
    pagesPerPartition (1), tries per page (4), pause before the second try in seconds (0.5, doubling).
    """

    class Paged(Ds.DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return make(dict(self.options)).schema

        def reader(self, schema: StructType) -> _Reader:
            return _Reader(make, {k.lower(): v for k, v in self.options.items()})

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Spark refuses readers that take filters without it
    spark.dataSource.register(Paged)


class FolderClient:
    """Parquet files under a path as a paged data set: a page per row group, files in name order. The path may lie in any store that
    pyarrow reads. Options: columns, and filterable columns (comma-separated)."""

    filterable: tuple[str, ...] = ()

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.files, root = pyarrow.fs.FileSystem.from_uri(options["path"])
        own = self.files.get_file_info(root)
        found = [own] if own.is_file else self.files.get_file_info(pyarrow.fs.FileSelector(root, recursive=True))
        self.names = sorted(f.path for f in found if f.is_file and f.path.endswith(".parquet"))
        self.filterable = tuple(c for c in options.get("filterable", "").split(",") if c)
        self.columns = [c for c in options.get("columns", "").split(",") if c]

    @property
    def schema(self) -> str:
        from pyspark.sql.pandas.types import from_arrow_schema

        own = pyarrow.parquet.read_schema(self.names[0], filesystem=self.files)
        own = pa.schema([own.field(c) for c in self.columns]) if self.columns else own
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in from_arrow_schema(own.remove_metadata(), prefer_timestamp_ntz=True))

    def places(self) -> list[tuple[str, int]]:
        return [(n, g) for n in self.names for g in range(pyarrow.parquet.read_metadata(n, filesystem=self.files).num_row_groups)]

    def pages(self) -> int:
        return len(self.places())

    def page(self, number: int, filters: list[tuple[str, str, Any]]) -> pa.Table:
        name, group = self.places()[number]
        needed = [*dict.fromkeys([*self.columns, *(c for c, _, _ in filters)])] if self.columns else None
        with pyarrow.parquet.ParquetFile(name, filesystem=self.files) as f:
            found = f.read_row_group(group, columns=needed)
        if filters:
            found = found.filter(pyarrow.parquet.filters_to_expression([(c, s, list(v) if s == "in" else v) for c, s, v in filters]))
        return found.select(self.columns) if self.columns else found


class _Written(Ds.WriterCommitMessage):
    def __init__(self, file: str | None, rows: int):
        self.file, self.rows = file, rows


class _Sink(Ds.DataSourceArrowWriter):
    """Tasks write files to a staging folder; the driver moves those of the tasks that Spark counts, then writes the run's marker."""

    def __init__(self, path: str, run: str):
        self.path, self.run = path.rstrip("/"), run

    def _files(self) -> tuple[pyarrow.fs.FileSystem, str, str, str]:
        files, root = pyarrow.fs.FileSystem.from_uri(self.path)
        return files, f"{root}/_staging/{self.run}", f"{root}/run={self.run}", f"{root}/_runs/{self.run}.json"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        files, staging, _, marker = self._files()
        if files.get_file_info(marker).is_file:  # this run's rows are there already
            return _Written(None, 0)
        files.create_dir(staging, recursive=True)
        c = TaskContext.get()
        name, out, rows = f"part-{c.partitionId():05}-{c.taskAttemptId()}.parquet", None, 0
        for b in iterator:
            out = out or pyarrow.parquet.ParquetWriter(f"{staging}/{name}", b.schema, filesystem=files)
            out.write_batch(b)
            rows += b.num_rows
        if out:
            out.close()
        return _Written(name if out else None, rows)

    def commit(self, messages: list[_Written | None]) -> None:
        files, staging, target, marker = self._files()
        if files.get_file_info(marker).is_file:
            return
        own = [m for m in messages if m is not None and m.file]
        if files.get_file_info(target).type != pyarrow.fs.FileType.NotFound:  # what a driver left that died before its marker
            files.delete_dir(target)
        files.create_dir(target, recursive=True)
        for m in own:
            files.move(f"{staging}/{m.file}", f"{target}/{m.file}")
        files.create_dir(marker.rpartition("/")[0], recursive=True)
        with files.open_output_stream(marker) as f:
            f.write(json.dumps({"run": self.run, "files": [m.file for m in own], "rows": sum(m.rows for m in own)}).encode())
        self.abort([])

    def abort(self, messages: list[_Written | None]) -> None:
        files, staging, _, _ = self._files()
        if files.get_file_info(staging).type != pyarrow.fs.FileType.NotFound:
            files.delete_dir(staging)


class RunSink(Ds.DataSource):
    """format("run_rows"): appends rows to the table at path as one run (option run). A failed write leaves no rows, attempts of a task
    that Spark does not count leave none either, and writing a run that is there already adds nothing."""

    @classmethod
    def name(cls) -> str:
        return "run_rows"

    def writer(self, schema: StructType, overwrite: bool) -> _Sink:
        options = {k.lower(): v for k, v in self.options.items()}
        return _Sink(options["path"], options["run"])


def write_run(df: DataFrame, path: str, run: str) -> None:
    """df as the run's rows of the table at path (a URI or an absolute path); see RunSink."""
    df.sparkSession.dataSource.register(RunSink)
    df.write.format("run_rows").option("path", path).option("run", run).mode("append").save()


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all runs that were committed, with column run."""
    files, root = pyarrow.fs.FileSystem.from_uri(path.rstrip("/"))
    done = files.get_file_info(pyarrow.fs.FileSelector(f"{root}/_runs", allow_not_found=True))
    runs = [f.path.rpartition("/")[2].removesuffix(".json") for f in done if f.path.endswith(".json")]
    if not runs:
        return spark.createDataFrame([], f"{schema}, run string")
    return spark.read.schema(f"{schema}, run string").option("basePath", path).parquet(*[f"{path.rstrip('/')}/run={r}" for r in sorted(runs)])
