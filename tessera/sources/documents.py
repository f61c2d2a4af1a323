"""Documents of projects as files, replaced a project at a time: a data source that writes with commit and abort, and reads.

A folder that driver and executors share holds one folder a project with its versions and a file CURRENT that names the one
that counts. Tasks write documents of a new version beside the old ones; the driver's commit points CURRENT at it, in one
atomic step a project, and drops the old versions. Projects that a write does not name stay as they are, and after an abort
all do; what tasks still running at an abort leave behind is read by nobody and goes with the next commit. A task that
runs twice writes the same files.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

DOCUMENTS = "project_id string, name string, document string"
CURRENT = "CURRENT"


def _file_name(name: str) -> str:
    """A name as one path segment; a leading dot is escaped too, so that no name means a folder."""
    return quote(name, safe="").replace(".", "%2E", 1) if name.startswith(".") else quote(name, safe="")


def _put(path: str, text: str) -> None:
    """Write a file as a whole: readers see the old one or the new one."""
    half = f"{path}.{uuid.uuid4().hex}.half"
    with open(half, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(half, path)


@dataclass
class Written(WriterCommitMessage):
    projects: list[str]


class DocumentsWriter(DataSourceWriter):
    def __init__(self, root: str) -> None:
        self.root, self.version = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        projects = set()
        for row in iterator:
            folder = os.path.join(self.root, _file_name(row["project_id"]), self.version)
            if row["project_id"] not in projects:
                os.makedirs(folder, exist_ok=True)
                projects.add(row["project_id"])
            _put(os.path.join(folder, f"{_file_name(row['name'])}.json"), row["document"])
        return Written(sorted(projects))

    def _folders(self, messages: list[Written | None]) -> list[str]:
        return [os.path.join(self.root, _file_name(p)) for p in sorted({p for m in messages if m for p in m.projects})]

    def commit(self, messages: list[Written | None]) -> None:
        for folder in self._folders(messages):
            _put(os.path.join(folder, CURRENT), self.version)
            for old in os.listdir(folder):
                if old not in (CURRENT, self.version) and os.path.isdir(os.path.join(folder, old)):
                    shutil.rmtree(os.path.join(folder, old), ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        # a task that failed left no message, so every project is looked at
        for project in os.listdir(self.root) if os.path.isdir(self.root) else []:
            shutil.rmtree(os.path.join(self.root, project, self.version), ignore_errors=True)


@dataclass
class Project(InputPartition):
    folder: str


class DocumentsReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[Project]:
        found = sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []
        return [Project(p) for p in found if os.path.isfile(os.path.join(self.root, p, CURRENT))] or [Project("")]

    def read(self, partition: Project) -> Iterator[tuple]:
        if not partition.folder:
            return
        with open(os.path.join(self.root, partition.folder, CURRENT), encoding="utf-8") as f:
            folder = os.path.join(self.root, partition.folder, f.read())
        for name in sorted(os.listdir(folder)):
            if name.endswith(".json"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    yield unquote(partition.folder), unquote(name[: -len(".json")]), f.read()


class DocumentsSource(DataSource):
    """df.write.format("projectdocuments").save(folder); spark.read.format("projectdocuments").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "projectdocuments"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DocumentsReader:
        return DocumentsReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DocumentsWriter:
        os.makedirs(self.options["path"], exist_ok=True)
        return DocumentsWriter(self.options["path"])


def write_documents(documents: DataFrame, folder: str) -> None:
    """documents(project_id, name, document) replace all that folder holds of their projects."""
    documents.sparkSession.dataSource.register(DocumentsSource)
    documents.select("project_id", "name", "document").write.format("projectdocuments").mode("append").save(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(DocumentsSource)
    return spark.read.format("projectdocuments").load(folder)


def parsed(document: str) -> dict:
    return json.loads(document)
