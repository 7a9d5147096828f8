"""One file a document as a data source ("docfiles"): pruned reads, and writes that appear as a whole or not at all.

    spark.dataSource.register(DocumentFiles)          # or documents.register(spark)
    spark.read.format("docfiles").option("patterns", "*_dtd_prob.npy;*.dtd.prob.npy").load(root)
    df.write.format("docfiles").option("existing", "skip").mode("append").save(root)

Files lie in root/partNNN/ or, where there is no such folder, in root itself.  Executors open them through pyarrow, so root is
a path or address that all of them reach.
"""

from __future__ import annotations

import math
import os
import re
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import translate
from itertools import batched

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

PART = re.compile(r"part\d{3,}")
SCHEMA = "part string, stem string, name string, content binary"


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address or absolute path, and the path in it."""
    local = re.fullmatch(r"file:/*(/.*)", root)
    return pafs.FileSystem.from_uri(local.group(1) if local else root)


def entries(files: pafs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """Names in a folder (none if it isn't one) and whether each is a folder; local ones are never held together."""
    if isinstance(files, pafs.LocalFileSystem):
        try:
            with os.scandir(folder) as found:
                yield from ((e.name, e.is_dir()) for e in found)
        except (FileNotFoundError, NotADirectoryError):
            return
    elif files.get_file_info(folder).type == pafs.FileType.Directory:
        yield from ((i.base_name, i.type == pafs.FileType.Directory) for i in files.get_file_info(pafs.FileSelector(folder)))


def below(files: pafs.FileSystem, folder: str, number: int = 0, of: int = 1) -> Iterator[str]:
    """Paths of the files below a folder; the number-th of `of` shares, dealt by the folder's own entries."""
    for name, is_folder in entries(files, folder):
        if (of == 1 or zlib.crc32(name.encode("utf-8", "surrogateescape")) % of == number) and not name.startswith("_staging-"):
            yield from below(files, f"{folder}/{name}") if is_folder else (f"{folder}/{name}",)


@dataclass
class Pattern:
    """A pattern of the last parts of a path; what its first * stands for is the stem."""

    text: str

    def __post_init__(self) -> None:
        self.depth = self.text.count("/") + 1
        head, star, tail = self.text.partition("*")
        self.head, self.tail, self.regex = head, tail, re.compile(translate(self.text).replace(".*", "[^/]*"))
        if not star:
            raise ValueError(f"a pattern needs a *: {self.text}")

    def stem(self, path: str) -> str | None:
        last = "/".join(path.split("/")[-self.depth :])
        return last[len(self.head) : len(last) - len(self.tail)] if self.regex.match(last) else None


@dataclass
class Files(InputPartition):
    """Some part folders, or a share of one: no names, a task lists its own."""

    root: str
    parts: list[str | None]
    pattern: Pattern
    stems: set[str] | None
    number: int = 0
    of: int = 1

    def listed(self) -> Iterator[tuple[str | None, str, str]]:
        """part, path and stem of its files."""
        files, root = opened(self.root)
        for part in self.parts:
            for path in below(files, f"{root}/{part}" if part else root, self.number, self.of):
                if (stem := self.pattern.stem(path)) is not None and (self.stems is None or stem in self.stems):
                    yield part, path, stem

    @property
    def found(self) -> list[tuple[str, str]]:
        return [(path, stem) for _, path, stem in self.listed()]


class DocumentReader(DataSourceReader):
    """part, stem, name (path below root), content.  Equalities and lists on part and stem are pushed down: other parts aren't
    listed, other stems aren't opened.  Of several patterns (a;b) the first that finds anything counts.

    The driver walks the tree once, name by name, to choose the pattern and count; it keeps counts of parts and no names.
    folders: "any" takes all files below root as one part.  contents: "false" leaves content null and empty files out.
    """

    def __init__(self, options: dict) -> None:
        self.root, self.per_task, self.most_shares = options["path"], int(options.get("filesPerTask", "500")), int(options.get("mostShares", "256"))
        self.patterns = [Pattern(p) for p in options.get("patterns", "*").split(";")]
        self.any, self.contents = options.get("folders", "parts") == "any", options.get("contents", "true") == "true"
        self.wanted: dict[str, set[str]] = {}
        self.listed: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in ("part", "stem") and values:
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def partitions(self) -> list[Files]:
        files, root = opened(self.root)
        wanted, stems = self.wanted.get("part"), self.wanted.get("stem")
        folders = [] if self.any else sorted(n for n, is_folder in entries(files, root) if is_folder and PART.fullmatch(n))
        parts = [p for p in folders if wanted is None or p in wanted] if folders else [None] if wanted is None else []
        # Of each part how many files fit each pattern, and whether any did before stems were looked at.
        counts, hit = {p: [0] * len(self.patterns) for p in parts}, [False] * len(self.patterns)
        for part in parts:
            self.listed.append(part or root.rsplit("/", 1)[-1])
            for path in below(files, f"{root}/{part}" if part else root):
                for k, pattern in enumerate(self.patterns):
                    if (stem := pattern.stem(path)) is not None:
                        hit[k] = True
                        counts[part][k] += stems is None or stem in stems
                        break
                    if hit[k]:
                        break
        if not any(hit):
            return []
        k = hit.index(True)
        out: list[Files] = []
        room = 0
        for part in parts:
            n = counts[part][k]
            if n > self.per_task:
                shares = min(math.ceil(n / self.per_task), self.most_shares)
                out += [Files(self.root, [part], self.patterns[k], stems, i, shares) for i in range(shares)]
                room = 0
            elif n:
                if n > room:
                    out.append(Files(self.root, [], self.patterns[k], stems))
                    room = self.per_task
                out[-1].parts.append(part)
                room -= n
        return out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        files, root = opened(self.root)
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["part", "stem", "name", "content"])

        for part, path, stem in partition.listed():
            content = None
            if self.contents:
                with files.open_input_stream(path) as f:
                    content = f.read()
            elif not files.get_file_info(path).size:
                continue
            held.append((part, stem, path[len(root.rstrip("/")) + 1 :], content))
            size += len(content or b"")
            if len(held) == 500 or size > 4_000_000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder; its names stay there."""

    folder: str


class DocumentWriter(DataSourceArrowWriter):
    """Tasks write into a staging folder of their own attempt; commit moves each file to its name in one step
    (new folders as they are, so that none of their names is listed), abort removes all.

    existing: "replace", or "skip" to leave files that are there.  Of rows with one name, one counts.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.root, self.existing = options["path"], "replace" if overwrite else options.get("existing", "replace")
        if self.existing not in ("skip", "replace"):
            raise ValueError(f"existing is skip or replace, not {self.existing}")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, root = opened(self.root)
        task = TaskContext.get()
        folder = f"{root}/{self.staging}/{task.partitionId()}-{task.taskAttemptId()}"
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if not name or name.startswith(("/", "_staging-")) or ".." in name.split("/"):
                    raise ValueError(f"not a name below the folder: {name!r}")
                if self.existing == "skip" and files.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                    continue
                target = f"{folder}/{name}"
                files.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with files.open_output_stream(target) as out:
                    out.write((content or "").encode() if not isinstance(content, bytes) else content)
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = opened(self.root)
        with ThreadPoolExecutor(16) as pool:
            for m in filter(None, messages):
                for some in batched(entries(files, m.folder), 1000):
                    places = list(pool.map(lambda e, staged=m.folder: not e[1] or not self._whole(files, f"{staged}/{e[0]}", f"{root}/{e[0]}"), some))
                    left = (p for (name, is_folder), by_file in zip(some, places, strict=True) if by_file for p in (below(files, f"{m.folder}/{name}") if is_folder else (f"{m.folder}/{name}",)))
                    for paths in batched(left, 1000):
                        names = [p[len(m.folder) + 1 :] for p in paths]
                        for folder in {f"{root}/{n}".rsplit("/", 1)[0] for n in names}:
                            files.create_dir(folder, recursive=True)
                        list(pool.map(lambda n, staged=m.folder: files.move(f"{staged}/{n}", f"{root}/{n}"), names))
        self._clear(files, root)

    @staticmethod
    def _whole(files: pafs.FileSystem, staged: str, target: str) -> bool:
        """Moves a folder by one rename where nothing has its name yet; other file systems than local ones move files."""
        if not isinstance(files, pafs.LocalFileSystem) or os.path.lexists(target):
            return False
        try:
            os.rename(staged, target)
        except OSError:  # another job made it meanwhile
            return False
        return True

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.root))

    def _clear(self, files: pafs.FileSystem, root: str) -> None:
        for left in reversed(range(20)):
            if files.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.Directory:
                return
            try:
                files.delete_dir(f"{root}/{self.staging}")
            except OSError:  # a task that is being stopped still writes
                if not left:
                    raise
                time.sleep(0.2)


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options)

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load_documents(spark: SparkSession, root: str, *patterns: str, **options: str) -> DataFrame:
    """part, stem, name, content of the files below root that fit the first pattern that finds any; options: the reader's."""
    register(spark)
    return spark.read.format("docfiles").option("patterns", ";".join(patterns or ("*",))).options(**options).load(root)


def write_documents(df: DataFrame, root: str, existing: str = "replace") -> None:
    """name, content of df as files below root; existing: replace, or skip the files that are there."""
    register(df.sparkSession)
    df.select("name", F.col("content").cast("binary").alias("content")).write.format("docfiles").option("existing", existing).mode("append").save(root)


def snapshot_patterns(parts: list[int] | None = None, kinds: tuple[str, ...] = ("image", "mask", "report"), split: str = "train", metadata_only: bool = False) -> list[str]:
    """Patterns of the files that a partial copy of the data set takes: metadata always, then whole kinds or their parts."""
    always = ["metadata.parquet", "metadata.csv", "README.md", "doc_sample.png"]  # fixed values: the data set's own files
    if metadata_only:
        return [*always, ".gitattributes"]
    inside = [""] if parts is None else [f"part{p:03d}/" for p in parts]
    return always + [f"{split}/{k}/{p}**" for k in kinds for p in inside]


def in_snapshot(path: str, patterns: list[str]):
    """Whether a path column lies in a partial copy: equal to a name, or below a folder that ends in **."""
    from functools import reduce

    return reduce(lambda a, b: a | b, [F.col(path).startswith(p[:-2]) if p.endswith("**") else F.col(path) == p for p in patterns])
