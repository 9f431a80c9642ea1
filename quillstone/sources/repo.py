"""A source repository as a table: ``spark.read.format("repository").option("path", dir).load()``.

Files are listed depth first, directories before files and then by path; unreadable folders are skipped. The driver lists the upper
levels only, as many as give SPREAD entries (three at most), and deals them to as many input partitions at most, so that large trees are read by many
tasks even if they hang on one folder. Options: path, recursive (true), content (true), excludedDirs,
excludedExtensions (comma-separated), maxBytes (no limit).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is left out unless the options say otherwise.
EXCLUDED_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv"]
EXCLUDED_EXTENSIONS = [".pyc", ".pyo", ".pyd", ".so", ".dll", ".exe"]
SPREAD, LEVELS = 64, 3
OPENED = 4 << 20  # characters of the files that a task holds at once
SCHEMA = "path string, name string, size long, modified_time double, is_directory boolean, extension string, content string"


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options)


class Entries(InputPartition):
    """Paths in order, and whether what is below them is read too."""

    def __init__(self, entries: list[tuple[str, bool]]):
        self.entries = entries


class RepositoryReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        if not os.path.isdir(self.root):
            raise ValueError(f"no such directory: {self.root}")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.content = options.get("content", "true").lower() == "true"
        split = lambda x: [p for p in x.split(",") if p]
        self.dirs = set(split(options["excludedDirs"]) if "excludedDirs" in options else EXCLUDED_DIRS)
        self.extensions = set(split(options["excludedExtensions"]) if "excludedExtensions" in options else EXCLUDED_EXTENSIONS)
        self.most = int(options.get("maxBytes", "0"))

    def _listed(self, folder: str) -> list[tuple[bool, str]]:
        found = []
        try:
            for e in os.scandir(os.path.join(self.root, folder)):
                path = os.path.join(folder, e.name) if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if e.name not in self.dirs:
                        found.append((False, path))
                elif os.path.splitext(e.name)[1] not in self.extensions:
                    found.append((True, path))
        except OSError:
            return []
        return sorted(found)

    def partitions(self) -> list[InputPartition]:
        found = lambda folder: [(path, not is_file and self.recursive) for is_file, path in self._listed(folder)]
        entries = found("")
        for _ in range(LEVELS):
            if len(entries) >= SPREAD or not any(deep for _, deep in entries):
                break
            entries = [x for path, deep in entries for x in ([(path, False), *found(path)] if deep else [(path, False)])]
        size = -(-len(entries) // SPREAD) or 1
        return [Entries(entries[i : i + size]) for i in range(0, len(entries), size)] or [Entries([])]

    def _row(self, path: str) -> tuple | None:
        full = os.path.join(self.root, path)
        try:
            info, folder = os.stat(full), os.path.isdir(full)
        except OSError:
            return None
        if not folder and self.most and info.st_size > self.most:
            return None
        text = None
        if self.content and not folder:
            try:
                with open(full, "rb") as f:
                    text = f.read().decode("utf-8", "replace")
            except OSError:
                text = None
        name = os.path.basename(path)
        return path, name, info.st_size, info.st_mtime, folder, "" if folder else os.path.splitext(name)[1], text

    def read(self, partition: Entries) -> Iterator[tuple]:
        for first, deep in partition.entries:
            todo = [first]
            while todo:
                path = todo.pop()
                row = self._row(path)
                if row is None:
                    continue
                yield row
                if row[4] and deep:
                    todo += [p for _, p in reversed(self._listed(path))]


def contents(files, root: str):
    """``files`` (path, ...) with the text of each in ``content``: these files are opened and no others, by many tasks, null where one can't be read. Columns stay."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, texts, held = 0, [], 0
            for i, path in enumerate(b.column(b.schema.get_field_index("path")).to_pylist()):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        texts.append(f.read().decode("utf-8", "replace"))
                except OSError:
                    texts.append(None)
                held += len(texts[-1] or "")
                if held > OPENED or i + 1 == b.num_rows:
                    part = b.slice(at, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*b.schema.names, "content"])
                    at, texts, held = i + 1, [], 0

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, files.count() // 500)
    return files.repartition(tasks).mapInArrow(run, StructType([*files.schema.fields, StructField("content", StringType())]))


def register(spark) -> None:
    spark.dataSource.register(RepositorySource)


def write_text(path: str, content: str) -> None:
    """Overwrite a file, creating its folders."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(content)


def remote(*_args, **_options):
    raise NotImplementedError("remote repositories are not supported; clone and read the folder")
