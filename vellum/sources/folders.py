"""Folders as a Spark data source: a reader that lists publications, empty ones too, and a writer of one file per publication."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Publications that one task lists, and files that the commit moves at once.
FOLDERS_OF_A_TASK, MOVERS, TRIES = 500, 32, 5
STAGING = "_staging-"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """A path's file system and its path there; a path without a scheme, or of the scheme file, is a local one."""
    local = re.fullmatch(r"(?:file:/*)?(/.*)", path) or re.fullmatch(r"file:/*(.*)", path)
    if local:
        return fs.LocalFileSystem(), "/" + local[1].strip("/")
    found, inner = fs.FileSystem.from_uri(path)
    return found, inner.rstrip("/")


@dataclass
class Folders(InputPartition):
    names: tuple[str, ...]


class Listing(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self) -> Sequence[InputPartition]:
        files, root = place(self.root)
        names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.Directory and not i.base_name.startswith(STAGING))
        return [Folders(tuple(names[k : k + FOLDERS_OF_A_TASK])) for k in range(0, max(1, len(names)), FOLDERS_OF_A_TASK)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        files, root = place(self.root)
        for name in partition.names:
            yield name, "", 0
            for info in files.get_file_info(fs.FileSelector(f"{root}/{name}", recursive=True)):
                folder = info.type == fs.FileType.Directory
                yield name, info.path[len(root) + len(name) + 2 :] + "/" * folder, 0 if folder else info.size


class PublicationFolders(DataSource):
    """(pub_id, path, size) of all files and folders below the publications; paths of folders end in a slash, and a
    publication's own path is empty."""

    @classmethod
    def name(cls) -> str:
        return "publication_folders"

    def schema(self) -> str:
        return "pub_id string, path string, size long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Listing(self.options["path"])


def list_folders(spark: SparkSession, root: str) -> DataFrame:
    """(pub_id, path, size) of everything below the publication folders in `root`, one task for FOLDERS_OF_A_TASK of them.

    A root that isn't there is a ValueError; one without folders gives no rows. Files in the root itself are no publications.
    """
    files, inner = place(root)
    if files.get_file_info(inner).type != fs.FileType.Directory:
        raise ValueError(f"no such folder: {root}")
    spark.dataSource.register(PublicationFolders)
    return spark.read.format("publication_folders").load(root)


@dataclass
class Written(WriterCommitMessage):
    moves: tuple[tuple[str, str], ...]


class Files(DataSourceWriter):
    """Each task writes its files to a folder of its own below the target; only the commit moves them to their names.

    So of a task that is tried again, or tried twice at once, only the files of the attempt that Spark committed appear,
    and an aborted job leaves nothing: its folder is made before the tasks begin, and one that outlives the job fails without it.
    """

    def __init__(self, root: str, template: str, columns: list[str]):
        self.root, self.template, self.job, self.columns = root, template, f"{STAGING}{uuid.uuid4().hex}", columns
        files, inner = place(root)
        files.create_dir(f"{inner}/{self.job}", recursive=True)

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = place(self.root)
        own, moves = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(own, recursive=False)
        for n, row in enumerate(iterator):
            key, text = row[0], row[1]
            if key is None or text is None or not re.fullmatch(r"[^/]+(?:/[^/]+)*", key) or ".." in key.split("/"):
                raise ValueError(f"no file can be named after {key!r}")
            with files.open_output_stream(f"{own}/{n}") as out:
                out.write(text.encode("utf-8", "surrogatepass"))
            moves.append((f"{own}/{n}", f"{root}/{self.template.replace('{key}', key)}"))
        return Written(tuple(moves))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = place(self.root)
        moves = [m for message in messages if message is not None for m in message.moves]
        targets = [t for _, t in moves]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("two rows have the same key")
        for folder in {t.rsplit("/", 1)[0] for t in targets}:
            files.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda m: files.move(*m), moves))
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = place(self.root)
        for attempt in range(TRIES):  # a task that outlives the job may write while the folder goes
            try:
                if files.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
                    files.delete_dir(f"{root}/{self.job}")
                return
            except OSError:
                if attempt == TRIES - 1:
                    raise
                time.sleep(0.2)


class PublicationFiles(DataSource):
    """Rows (key, text) as files; the option `file` is their path below the target, in which {key} stands for the key."""

    @classmethod
    def name(cls) -> str:
        return "publication_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return Files(self.options["path"], self.options.get("file", "{key}/{key}.json"), schema.names)


def write_files(rows: DataFrame, path: str, text: str, file: str = "{key}/{key}.json", key: str = "pub_id") -> None:
    """One file for each row below `path`: publications as {key}/{key}.json, bibliographies as {key}/refs.bib, and so on.

    Files that are there are replaced, others stay. Keys must be given, told apart, and no way out of the folder. The commit
    is one rename for each file, from the driver; for tables of very many small texts `sinks.write_texts` needs none.
    """
    spark = rows.sparkSession
    spark.dataSource.register(PublicationFiles)
    rows.select(rows[key].cast("string").alias("key"), rows[text].alias("text")).write.format("publication_files").mode("append").option("file", file).save(path)
