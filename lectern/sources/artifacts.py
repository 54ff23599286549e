"""Artifact files under their own names, `<stem><suffix>`, as a Spark data source: a sink with commit, and a pruned reader.

Files lie in one folder, or in folders of shards by a hash of the stem, so that a listing is a task for each shard and none
on the driver. A task writes its files to a folder of its own and moves each to its name when all are written, so a
reader sees whole files only, and a repeated task replaces its files by the same ones. The folders of tasks are removed when
the job commits or aborts; a commit leaves `_SUCCESS`.

Defined cases: a null content is an empty file; a null or empty stem, or an unknown artifact, fails the write; of several rows of a
name one stays; other characters of a stem than letters, digits and `._-` are percent-encoded in the name.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import quote, unquote

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

#: Suffixes of artifacts; the index of frames has a folder for each stem.
SUFFIXES = {
    "notes": "_study_notes.md", "report": "_academic_report.pdf", "flashcards": "_flashcards.json", "quiz": "_quiz.json", "graph": "_knowledge_graph.json", "progress": "_progress.json",
    "transcript_txt": "_transcript.txt", "transcript_json": "_transcript.json", "frames": "/frames_index.json",
}

SCHEMA = "stem string, artifact string, path string, length long, modificationTime timestamp, content binary"
LISTING = "stem string, artifact string, path string, length long, modificationTime timestamp"
STAGING = "_staging"


def name_of(stem: str, artifact: str) -> str:
    return quote(stem, safe="") + SUFFIXES[artifact]


def artifact_of(name: str) -> tuple[str, str] | None:
    """stem and artifact of a file's name in its shard, or None."""
    for artifact, suffix in SUFFIXES.items():
        if name.endswith(suffix) and len(name) > len(suffix) and "/" not in name[: -len(suffix)]:
            return unquote(name[: -len(suffix)]), artifact
    return None


def shard_of(stem: str, shards: int) -> str:
    """The folder of a stem: none for one shard, else a number."""
    return f"{zlib.crc32(stem.encode()) % shards:04d}" if shards > 1 else ""


def _open(path: str):
    """The file system of a path or URI, and the path in it."""
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _join(*parts: str) -> str:
    return "/".join(p for p in parts if p)


class ArtifactFiles(DataSource):
    """Options: path, shards (1), and for reads of other folders prefixes, names of folders in path separated by commas."""

    @classmethod
    def name(cls) -> str:
        return "artifact_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArtifactReader:
        return ArtifactReader(self.options, schema.names)

    def writer(self, schema, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.options, schema.names)


# --- sink --------------------------------------------------------------------------------------------------------


class Written(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class ArtifactWriter(DataSourceWriter):
    def __init__(self, options: dict, names: list[str]):
        if missing := {"stem", "artifact", "content"} - set(names):
            raise ValueError(f"columns {sorted(missing)} are missing")
        self.path, self.shards, self.job = options["path"], int(options.get("shards", 1)), uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        files, root = _open(self.path)
        own, done = _join(root, STAGING, self.job, uuid.uuid4().hex), {}
        for row in rows:
            if not row["stem"] or row["artifact"] not in SUFFIXES:
                raise ValueError(f"no file for stem {row['stem']!r} and artifact {row['artifact']!r}")
            name = name_of(row["stem"], row["artifact"])
            target = _join(root, shard_of(row["stem"], self.shards), name)
            staged = done.setdefault(target, f"{own}/{len(done)}")
            if len(done) == 1:
                files.create_dir(own, recursive=True)
            content = row["content"] or b""
            with files.open_output_stream(staged) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content))
        for target, staged in done.items():
            files.create_dir(target.rpartition("/")[0], recursive=True)
            files.move(staged, target)
        return Written(len(done))

    def _cleared(self):
        files, root = _open(self.path)
        if files.get_file_info(_join(root, STAGING, self.job)).type != arrow_fs.FileType.NotFound:
            files.delete_dir(_join(root, STAGING, self.job))
        return files, root

    def commit(self, messages: list) -> None:
        files, root = self._cleared()
        files.create_dir(root, recursive=True)
        with files.open_output_stream(_join(root, "_SUCCESS")) as out:
            out.write(b"")

    def abort(self, messages: list) -> None:
        self._cleared()


# --- reader ------------------------------------------------------------------------------------------------------


class Shard(InputPartition):
    def __init__(self, folder: str, stems: tuple[str, ...] | None):
        self.folder, self.stems = folder, stems


class ArtifactReader(DataSourceReader):
    """A partition is a shard. Stems and artifacts that filters name are the only files looked at."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.shards, self.names = options["path"], int(options.get("shards", 1)), names
        self.prefixes = [p for p in options.get("prefixes", "").split(",") if p]
        self.stems: set[str] | None = None
        self.artifacts: set[str] = set(SUFFIXES)

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("stem",):
                self.stems = values if self.stems is None else self.stems & values
            elif values is not None and f.attribute == ("artifact",):
                self.artifacts &= values
            else:
                yield f

    def partitions(self) -> list[Shard]:
        if self.prefixes:
            return [Shard(p, None) for p in self.prefixes]
        if self.stems is None:
            return [Shard(f"{i:04d}" if self.shards > 1 else "", None) for i in range(self.shards)]
        by_shard: dict[str, list[str]] = {}
        for stem in sorted(self.stems):
            by_shard.setdefault(shard_of(stem, self.shards), []).append(stem)
        return [Shard(folder, tuple(stems)) for folder, stems in by_shard.items()]

    def read(self, shard: Shard) -> Iterator[tuple]:
        files, root = _open(self.path)
        base = _join(root, shard.folder)
        if shard.stems is not None:
            wanted = [f"{base}/{name_of(s, a)}" for s in shard.stems for a in sorted(self.artifacts)]
            found = [i for i in files.get_file_info(wanted) if i.type == arrow_fs.FileType.File] if wanted else []
        else:
            found = [i for i in files.get_file_info(arrow_fs.FileSelector(base, allow_not_found=True, recursive=True)) if i.type == arrow_fs.FileType.File]
        for info in found:
            name = info.path[len(base) :].lstrip("/")
            told = artifact_of(name)
            if name.startswith(STAGING + "/") or told is None or told[1] not in self.artifacts or self.stems is not None and told[0] not in self.stems:
                continue
            row = {"stem": told[0], "artifact": told[1], "path": info.path, "length": info.size, "modificationTime": datetime.fromtimestamp(info.mtime_ns / 1e9, timezone.utc)}
            if "content" in self.names:
                with files.open_input_stream(info.path) as f:
                    row["content"] = f.readall()
            yield tuple(row[n] for n in self.names)


def write_artifacts(rows: DataFrame, path: str, shards: int = 1) -> None:
    """Rows of stem, artifact and content (a string or bytes) as files."""
    spark = rows.sparkSession
    spark.dataSource.register(ArtifactFiles)
    rows.select("stem", "artifact", rows["content"].cast("binary").alias("content")).write.format("artifact_files").option("shards", shards).mode("append").save(path)


def read_artifacts(spark: SparkSession, path: str, shards: int = 1, contents: bool = True, prefixes: list[str] | None = None) -> DataFrame:
    """The files of a folder with stem and artifact; without contents it is a listing.

    Equality filters on stem and artifact decide which shards and files are looked at.
    """
    spark.dataSource.register(ArtifactFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("artifact_files").schema(SCHEMA if contents else LISTING).option("shards", shards)
    return (reader.option("prefixes", ",".join(prefixes)) if prefixes else reader).load(path)
