"""Whole files as rows, empty ones too, which Spark's own file sources skip: a data source that lists on the driver and
reads in partitions of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FILES = "path string, modificationTime timestamp, length bigint, content binary"
PART_BYTES, PART_FILES = 64 << 20, 1000


@dataclass
class Part(InputPartition):
    names: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, root there, and what Spark puts before a path of it."""
    if "://" not in path:
        path = "file://" + path.removeprefix("file:")
    system, root = fs.FileSystem.from_uri(path)
    scheme, _, rest = path.partition("://")
    return system, root, "file:" if scheme == "file" else f"{scheme}://{rest[: len(rest) - len(root)]}" if rest.endswith(root) else f"{scheme}://"


class WholeFilesReader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Part]:
        system, root, _ = _opened(self.path)
        top = system.get_file_info(root)
        found = [top] if top.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        hidden = lambda name: any(x[:1] in ("_", ".") for x in name[len(root) :].split("/"))
        out, names, size = [], [], 0
        for info in sorted((f for f in found if f.is_file and not hidden(f.path)), key=lambda f: f.path):
            if names and (size + info.size > PART_BYTES or len(names) == self.most):
                out.append(Part(names))
                names, size = [], 0
            names.append(info.path)
            size += info.size
        return [*out, Part(names)]

    def read(self, partition: Part) -> Iterator[tuple]:
        system, _, before = _opened(self.path)
        for name in partition.names:
            info = system.get_file_info(name)
            with system.open_input_stream(name, compression=None) as f:
                content = f.read()
            yield before + name, info.mtime, len(content), content


class WholeFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "whole_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> WholeFilesReader:
        return WholeFilesReader(self.options["path"], int(self.options.get("partFiles", PART_FILES)))


def read_files(spark: SparkSession, path: str, part_files: int = PART_FILES) -> DataFrame:
    """(path, modificationTime, length, content) of every file under ``path``, hidden ones excepted, in partitions of at most
    PART_BYTES (or one file) and ``part_files`` files."""
    spark.dataSource.register(WholeFiles)
    return spark.read.format("whole_files").option("partFiles", part_files).load(path)
