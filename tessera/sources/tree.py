"""A project tree as rows: the "sourcetree" data source, and rows given directly.

Paths are listed once on the driver, pruning ignored folders; contents are read by tasks, CHUNK files each. The built-in
binary source is no substitute, since it leaves out names that begin with _ or a dot. Every executor must see the root.
Unreadable files are empty; malformed UTF-8 becomes U+FFFD.
"""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What is never read.
IGNORED_FOLDERS = {
    ".git", ".agent", ".agents", ".next", ".turbo", ".vercel", ".astro", ".svelte-kit", ".nuxt", ".output", ".cache",
    ".yarn", "build", "coverage", "dist", "node_modules", "out", "venv", ".venv", "__pycache__",
}
IGNORED_EXTENSIONS = (
    ".lock", ".log", ".map", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".ico", ".pdf", ".zip", ".woff", ".woff2", ".ttf", ".eot",
    ".mp4", ".mov", ".mp3", ".wav", ".wasm",
)
IGNORED_FILES = {"package-lock.json", "npm-shrinkwrap.json", "pnpm-lock.yaml", "yarn.lock", "bun.lock", "bun.lockb"}

# What a lock file at the root says of the package manager, first that is there.
LOCK_FILES = {
    "pnpm-lock.yaml": "pnpm", "package-lock.json": "npm", "npm-shrinkwrap.json": "npm", "yarn.lock": "yarn", "bun.lock": "bun", "bun.lockb": "bun",
}
FACTS = "project_id string, fact string, value string"

FILES = "project_id string, path string, extension string, size long, lines int, content string"
CHUNK = 200


class IgnoreRules:
    """Patterns of an ignore file: the last one that matches decides, "!" takes a path back in."""

    def __init__(self, text: str = "") -> None:
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            folder, line = line.endswith("/"), line.rstrip("/")
            anchored, line = "/" in line, line.lstrip("/")
            body = ""
            for part in re.split(r"(\*\*/|/\*\*|\*\*|\*|\?|\[[^]]*\])", line):
                body += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part if part.startswith("[") else re.escape(part))
            self.rules.append((keep, folder, re.compile(("" if anchored else "(?:.*/)?") + body + r"(?:/.*)?\Z" if not folder else ("" if anchored else "(?:.*/)?") + body + r"\Z")))

    def match(self, path: str, is_folder: bool) -> bool:
        out = False
        for keep, folder, pattern in self.rules:
            if (not folder or is_folder) and pattern.match(path):
                out = not keep
        return out


def ignored(path: str, is_folder: bool, rules: IgnoreRules) -> bool:
    parts = path.split("/")
    return (
        any(p in IGNORED_FOLDERS for p in parts)
        or not is_folder
        and (parts[-1] in IGNORED_FILES or path.startswith(".env") or "/.env" in path or "public/assets/" in path
             or fnmatch.fnmatchcase(path, "*.min.[jt]s") or path.endswith(IGNORED_EXTENSIONS))
        or rules.match(path, is_folder)
    )


def list_files(root: str) -> list[str]:
    """Project-relative paths of all files that are read, in order."""
    text = ""
    for name in (".gitignore", ".git/info/exclude"):
        if os.path.isfile(at := os.path.join(root, name)):
            with open(at, encoding="utf-8", errors="replace") as f:
                text += f.read() + "\n"
    rules, found = IgnoreRules(text), []
    for folder, folders, names in os.walk(root):
        here = os.path.relpath(folder, root).replace(os.sep, "/")
        at = "" if here == "." else here + "/"
        folders[:] = sorted(d for d in folders if not ignored(at + d, True, rules))
        found += [at + n for n in names if not ignored(at + n, False, rules)]
    return sorted(found)


class Chunk(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, root: str, project: str) -> None:
        self.root, self.project = root, project

    def partitions(self) -> list[Chunk]:
        found = list_files(self.root)
        return [Chunk(found[i : i + CHUNK]) for i in range(0, max(len(found), 1), CHUNK)]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    raw = f.read()
            except OSError:
                raw = b""
            content = raw.decode("utf-8", "replace")
            lines = len(re.split("\r?\n", content)) if content else 0
            yield self.project, path, os.path.splitext(path)[1].lower(), len(raw), lines, content


class TreeSource(DataSource):
    """spark.read.format("sourcetree").option("project", name).load(root)"""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> TreeReader:
        root = self.options["path"]
        return TreeReader(root, self.options.get("project") or os.path.basename(os.path.abspath(root)))


class FactsReader(TreeReader):
    def partitions(self) -> list[Chunk]:
        return [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        held = (manager for name, manager in LOCK_FILES.items() if os.path.exists(os.path.join(self.root, name)))
        yield self.project, "lock_manager", next(held, None)
        yield self.project, "folder_name", os.path.basename(os.path.abspath(self.root))


class FactsSource(TreeSource):
    """What a tree tells besides the files that are read, some of which are never listed: as sourcetree, rows of FACTS."""

    @classmethod
    def name(cls) -> str:
        return "sourcetreefacts"

    def schema(self) -> str:
        return FACTS

    def reader(self, schema) -> FactsReader:
        made = super().reader(schema)
        return FactsReader(made.root, made.project)


def read_facts(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    """(project_id, fact, value): lock_manager, the package manager of the first lock file, or null; folder_name."""
    spark.dataSource.register(FactsSource)
    reader = spark.read.format("sourcetreefacts")
    return (reader.option("project", project) if project else reader).load(root)


def read_tree(spark: SparkSession, root: str, project: str | None = None) -> DataFrame:
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("sourcetree")
    return (reader.option("project", project) if project else reader).load(root)


def from_rows(spark: SparkSession, project: str, files: dict[str, str]) -> DataFrame:
    """A files table of path to content, for small projects."""
    rows = [(project, p, os.path.splitext(p)[1].lower(), len(c.encode()), len(re.split("\r?\n", c)) if c else 0, c) for p, c in files.items()]
    return spark.createDataFrame(rows, FILES)
