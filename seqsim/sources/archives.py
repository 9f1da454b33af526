"""A Spark data source for the CSV files in zip archives: one partition for each member, inflated as a stream."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Member(InputPartition):
    def __init__(self, path: str, name: str) -> None:
        self.path, self.name = path, name


def opened(path: str) -> pa.NativeFile:
    """A file by its path or its address in a store that pyarrow knows."""
    where, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return where.open_input_file(inside)


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, paths: list[str], sep: str) -> None:
        self.schema, self.paths, self.sep = to_arrow_schema(schema), paths, sep

    def partitions(self) -> list[Member]:
        """The members of each archive by its directory; nothing is inflated."""
        out = []
        for path in self.paths:
            with opened(path) as file, zipfile.ZipFile(file) as archive:
                out += [Member(path, x.filename) for x in archive.infolist() if not x.is_dir()]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        kinds = {f.name: f.type for f in self.schema}
        options = pc.ConvertOptions(column_types=kinds, include_columns=names, strings_can_be_null=True, null_values=[""], quoted_strings_can_be_null=False)
        with opened(partition.path) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
            if not archive.getinfo(partition.name).file_size:
                return
            parse = pc.ParseOptions(delimiter=self.sep, newlines_in_values=True)
            with pc.open_csv(member, parse_options=parse, convert_options=options) as batches:
                for batch in batches:
                    yield batch.cast(self.schema) if batch.schema != self.schema else batch


class ZippedCsv(DataSource):
    """Format "zipped_csv": options `paths` (a JSON list of archives) and `sep`; the schema names the columns to read, which
    members have by their headers. An empty field is null, an empty quoted one is an empty string."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedReader(schema, json.loads(self.options["paths"]), self.options.get("sep", ","))


def read_zipped(spark: SparkSession, paths: str | Sequence[str], schema: str, sep: str = ",") -> DataFrame:
    """Rows of the CSV files in zip archives, each file read by a task of its own. Fields may be quoted, and hold line breaks
    then; an empty field is null. A member without bytes has no rows, one without a column of the schema is an error."""
    spark.dataSource.register(ZippedCsv)
    held = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format("zipped_csv").schema(schema).option("paths", json.dumps(held)).option("sep", sep).load()
