"""Source files of checkouts: a data source lists them, Spark filters the listing, tasks read what is left.

A root folder holds one folder per repository (`levels` folders deep, so that `owner/name` is 2; 0 means that the root is one repository).
Spark's own file sources leave out every name that begins with an underscore, so `__init__.py` would be lost; this source lists folders itself.

The driver lists repositories only and deals them to `tasks` input partitions; a partition walks its repositories and does not enter skipped
folders. Filters on repo drop repositories before they are walked, filters on file and length drop paths in the task. A listing is filtered or
joined like any table (the files that changed, say), and `with_content` reads the paths that are left. It deals them by hash, so a repository
with a third of all files is read by all tasks; contents go to Spark in Arrow batches of bounded size.

Roots may be plain paths, `file:` or any store pyarrow knows by its URI. An executor that is lost costs its partitions, which are read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS

from patchlight import constants as C

LISTED = "repo string, file string, length bigint"
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
TASKS = 200


def is_reviewed(file: str, length: int, max_bytes: int = C.MAX_SOURCE_BYTES) -> bool:
    """What `code.reviewed_source` says of a path and size."""
    *folders, name = file.split("/")
    stem, dot, suffix = name.rpartition(".")
    return (
        bool(stem) and dot + suffix in C.LANGUAGE_OF_SUFFIX and length <= max_bytes and not any(map(skipped_folder, folders))
        and not any(p in name for p in C.SOURCE_SKIP_PATTERNS))


def skipped_folder(name: str) -> bool:
    return name in C.SOURCE_SKIP_DIRS or name.startswith(".")


def _store(root: str):
    """The file system of a root and its path there."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root.rstrip("/")
    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root.removeprefix("file:").strip("/")
    store, path = fs.FileSystem.from_uri(root)
    return store, path.rstrip("/")


def _entries(store, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """Names of the folders in a folder, and names and sizes of its files, each in order."""
    from pyarrow import fs

    found = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.base_name)
    return [x.base_name for x in found if x.type == fs.FileType.Directory], [(x.base_name, x.size) for x in found if x.type == fs.FileType.File]


def _walk(store, base: str) -> Iterator[tuple[str, int]]:
    """Paths below base and sizes, skipped folders left out."""
    open_folders = [""]
    while open_folders:
        at = open_folders.pop()
        folders, files = _entries(store, f"{base}/{at}".rstrip("/"))
        open_folders += [f"{at}{name}/" for name in reversed(folders) if not skipped_folder(name)]
        yield from ((at + name, size) for name, size in files)


#: Tests of a pushed filter: (value of the row, value of the filter).
TESTS: dict[type, Callable] = {
    DS.EqualTo: lambda a, b: a == b, DS.In: lambda a, b: a in b, DS.GreaterThan: lambda a, b: a > b, DS.GreaterThanOrEqual: lambda a, b: a >= b,
    DS.LessThan: lambda a, b: a < b, DS.LessThanOrEqual: lambda a, b: a <= b, DS.StringStartsWith: lambda a, b: a.startswith(b),
    DS.StringEndsWith: lambda a, b: a.endswith(b), DS.StringContains: lambda a, b: b in a,
}


def _listed(filter: DS.Filter) -> bool:
    """Whether a filter can be answered from the listing."""
    if isinstance(filter, DS.Not):
        return _listed(filter.child)
    if isinstance(filter, DS.IsNotNull):
        return filter.attribute[0] in ("repo", "file", "length")
    return type(filter) in TESTS and filter.attribute in (("repo",), ("file",), ("length",)) and filter.value is not None


def _passes(filter: DS.Filter, row: dict) -> bool:
    if isinstance(filter, DS.Not):
        return not _passes(filter.child, row)
    if isinstance(filter, DS.IsNotNull):
        return True
    return TESTS[type(filter)](row[filter.attribute[0]], filter.value)


@dataclass
class Repositories(DS.InputPartition):
    repos: list[str]


class CheckoutReader(DS.DataSourceReader):
    def __init__(self, options):
        self.root, self.levels, self.tasks = options["path"], int(options.get("levels", 1)), int(options.get("tasks", TASKS))
        self.max_bytes, self.filters = int(options.get("maxBytes", C.MAX_SOURCE_BYTES)), []

    def pushFilters(self, filters):
        for f in filters:
            if _listed(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        store, root = _store(self.root)
        repos = [""]
        for _ in range(self.levels):
            repos = [f"{r}/{name}".lstrip("/") for r in repos for name in _entries(store, f"{root}/{r}".rstrip("/"))[0]]
        of_repo = [f for f in self.filters if (f.child if isinstance(f, DS.Not) else f).attribute == ("repo",)]
        repos = [r for r in repos if all(_passes(f, {"repo": r}) for f in of_repo)]
        return [Repositories(repos[i :: self.tasks]) for i in range(min(self.tasks, len(repos)))] or [Repositories([])]

    def read(self, partition):
        store, root = _store(self.root)
        rows = []
        for repo in partition.repos:
            for file, length in _walk(store, f"{root}/{repo}".rstrip("/")):
                if is_reviewed(file, length, self.max_bytes) and all(_passes(f, {"repo": repo, "file": file, "length": length}) for f in self.filters):
                    rows.append((repo, file, length))
                if len(rows) == BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, types = ("repo", "file", "length", "content"), (pa.string(), pa.string(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names[: len(columns)]))


class Checkouts(DS.DataSource):
    @classmethod
    def name(cls):
        return "checkouts"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return CheckoutReader(self.options)


def list_checkouts(spark: SparkSession, root: str, levels: int = 1, tasks: int = TASKS, max_bytes: int = C.MAX_SOURCE_BYTES) -> DataFrame:
    """repo, file, length of the source files worth indexing in every repository below root. Sets the session's switch for pushed filters."""
    spark.dataSource.register(Checkouts)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("checkouts").option("levels", levels).option("tasks", tasks).option("maxBytes", max_bytes).load(root)


def with_content(listing: DataFrame, root: str) -> DataFrame:
    """repo, file, length, content of listed files; bytes that are no UTF-8 are replaced. A file that is gone by now is an error."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            rows, held = [], 0
            for repo, file, length in zip(*(batch.column(c).to_pylist() for c in ("repo", "file", "length")), strict=True):
                with store.open_input_stream("/".join(x for x in (base, repo, file) if x)) as stream:
                    rows.append((repo, file, length, stream.read().decode("utf-8", "replace")))
                held += length
                if held >= BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)

    return listing.select("repo", "file", "length").repartition("repo", "file").mapInArrow(run, f"{LISTED}, content string")


def write_checkouts(files: DataFrame, root: str) -> int:
    """Files (repo, file, content) as checkouts below root; returns how many. A file written again is replaced whole, so a task may run twice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(root)
        for batch in batches:
            for repo, file, content in zip(*(batch.column(c).to_pylist() for c in ("repo", "file", "content")), strict=True):
                path = f"{base}/{repo}/{file}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                # Of two runs of a task each writes a file of its own; the last to finish gives the name its content.
                own = f"{path}.{_attempt()}.part"
                with store.open_output_stream(own) as out:
                    out.write((content or "").encode())
                store.move(own, path)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return int(files.select("repo", "file", "content").mapInArrow(run, "n bigint").groupBy().sum("n").first()[0] or 0)


def _attempt() -> int:
    from pyspark import TaskContext

    return TaskContext.get().taskAttemptId()
