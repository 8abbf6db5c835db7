"""A Python data source that writes lines to files which all begin with the same lines."""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def line(*columns: Column) -> Column:
    """A line of CSV: every value in quotes, quotes doubled, so no line can be taken for a comment."""
    return F.concat_ws(",", *[F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in columns])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path that driver and executors share, and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclasses.dataclass
class Written(WriterCommitMessage):
    name: str | None  # of the staged file; None where a task had no rows


class AuditCsv(DataSource):
    """``audit_csv``: options ``path`` (a shared folder) and ``head``, the text that every file begins with; rows are lines."""

    @classmethod
    def name(cls) -> str:
        return "audit_csv"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return LineWriter(self.options["path"], self.options["head"], overwrite)


class LineWriter(DataSourceArrowWriter):
    """Tasks stage files under names of their own; the commit moves those of the tasks that count and, after it, nothing else is left.

    A task that is run again, for a lost executor or in parallel, stages another file that only the commit's messages make visible."""

    def __init__(self, path: str, head: str, overwrite: bool):
        self.path, self.head, self.overwrite, self.job = path, head, overwrite, uuid.uuid4().hex

    @property
    def _staged(self) -> str:
        return f"{_place(self.path)[1]}/_staged-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        at, name, out = _place(self.path)[0], f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.csv", None
        for batch in iterator:
            if batch.num_rows == 0:
                continue
            if out is None:
                at.create_dir(self._staged, recursive=True)
                out = at.open_output_stream(f"{self._staged}/{name}")
                out.write(self.head.encode())
            out.write("".join(f"{x}\n" for x in batch.column(0).to_pylist()).encode())
        if out is None:
            return Written(None)
        out.close()
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        at, root = _place(self.path)
        at.create_dir(self._staged, recursive=True)
        names = [m.name for m in messages if m is not None and m.name]
        if not names:  # a report without findings is one all the same
            names = [f"part-00000-{self.job}.csv"]
            with at.open_output_stream(f"{self._staged}/{names[0]}") as out:
                out.write(self.head.encode())
        if self.overwrite:
            for f in at.get_file_info(fs.FileSelector(root)):
                if f.base_name.startswith("part-") or f.base_name == "_SUCCESS":
                    at.delete_file(f.path)
        for n in names:
            at.move(f"{self._staged}/{n}", f"{root}/{n}")
        at.delete_dir(self._staged)
        with at.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        at, _ = _place(self.path)
        if at.get_file_info(self._staged).type != fs.FileType.NotFound:
            at.delete_dir(self._staged)
