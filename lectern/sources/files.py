"""Media and artifact files: intake by extension, text extraction, artifact listings, JSON artifacts.

Files are read with Spark's binaryFile source, so any store that Spark reaches will do; listings read no content.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import filename_title, words
from lectern.sources import artifacts as artifact_files

#: File extensions by kind of upload.
EXTENSIONS = {
    "video": ["mp4", "avi", "mov", "mkv", "wmv", "flv", "webm", "m4v"],
    "image": ["jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp"],
    "audio": ["wav", "mp3", "m4a", "flac", "ogg", "aac", "wma"],
    "document": ["pdf", "doc", "docx", "ppt", "pptx", "txt"],
}
#: Suffixes of artifacts; frames have a folder for each stem with an index in it.
ARTIFACTS = {"notes": "_study_notes.md", "report": "_academic_report.pdf", "flashcards": "_flashcards.json", "quiz": "_quiz.json", "graph": "_knowledge_graph.json", "progress": "_progress.json"}
FRAMES_INDEX = "frames_index.json"
MAX_CHARS, MAX_PAGES = 150_000, 40


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def uploadable(path: Column, kind: str) -> Column:
    """Whether a file may be uploaded as video, audio, image or document (S3)."""
    return F.coalesce(extension(path).isin(EXTENSIONS[kind]), F.lit(False))


def intake(spark: SparkSession, path: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """Files of an upload folder with an allowed extension, and those that are refused (S3)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    allowed = uploadable(F.col("path"), kind)
    return files.where(allowed), files.where(~allowed).select("path", "length", extension(F.col("path")).alias("extension"))


def decode(content: bytes) -> str:
    """UTF-8 with or without a mark, else Latin-1, which takes any bytes."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def _xml_text(content: bytes, part: str, paragraph: str) -> list[str]:
    """Text of each part of an Office file, by paragraphs."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted((n for n in z.namelist() if re.fullmatch(part, n)), key=lambda n: (len(n), n))
        pages = [re.sub(rf"</{paragraph}>", "\n", z.read(n).decode("utf-8")) for n in names]
    return [unescape(re.sub(r"<[^>]+>", "", p)).strip() for p in pages]


def _pdf_pages(content: bytes) -> list[str]:
    """Text of a PDF's pages (S4); without an installed parser an error, which pages() tells in a row."""
    from pypdf import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001  one page that can't be read is an empty page
            pages.append("")
    return pages


def page_texts(path: str, content: bytes) -> list[str]:
    """Texts of a document's pages; one page for formats without any."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "pdf":
        return _pdf_pages(content)
    if kind == "docx":
        return ["\n".join(_xml_text(content, r"word/document\.xml", "w:p"))]
    if kind == "pptx":
        return _xml_text(content, r"ppt/slides/slide\d+\.xml", "a:p")
    return [decode(content)]


def pages(files: DataFrame) -> DataFrame:
    """path, page_num from 1, text and error for each page; a file that can't be read is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, i, t, None) for i, t in enumerate(page_texts(path, content), 1)]
                except Exception as e:  # noqa: BLE001  told in the row
                    rows.append((path, 0, "", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, page_num int, text string, error string")


def first_pages(pages_: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    return pages_.where(F.col("page_num") <= most)


def documents(pages_: DataFrame, most: int = MAX_CHARS) -> DataFrame:
    """path, title, text (at most so many characters), word_count, char_count and error of each document."""
    ordered = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    whole = pages_.groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("_whole"), F.first("error", True).alias("error"))
    cut = F.when(F.length("_whole") > most, F.lit(f"[Text truncated to {most:,} chars]"))
    whole = whole.withColumns({"text": F.substring("_whole", 1, most), "error": F.nullif(F.concat_ws(" ", "error", cut), F.lit(""))})
    return whole.select("path", filename_title(F.col("path")).alias("title"), "text", words(F.col("text")).alias("word_count"), F.length("text").cast("long").alias("char_count"), "error")


def artifact_of(path: Column) -> Column:
    """stem and artifact of a file by its name, null for others (S7, S8): <stem><suffix>, or <stem>/frames_index.json."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    found = F.when(name == FRAMES_INDEX, F.struct(F.regexp_extract(path, "([^/]*)/[^/]*$", 1).alias("stem"), F.lit("frames").alias("artifact")))
    for k, suffix in ARTIFACTS.items():
        stem = F.regexp_replace(name, re.escape(suffix) + "$", "")
        found = found.when(name.endswith(suffix), F.struct(stem.alias("stem"), F.lit(k).alias("artifact")))
    return found


def listed(files: DataFrame) -> DataFrame:
    """stem, artifact, path and modificationTime of the artifacts among files (path, modificationTime)."""
    found = files.withColumn("_a", artifact_of(F.col("path"))).where("_a is not null")
    return found.select("_a.stem", "_a.artifact", "path", "modificationTime")


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """The artifacts below a folder; contents aren't read."""
    return listed(objects(spark, path))


def stems(listing: DataFrame) -> DataFrame:
    """Every stem with an artifact other than progress, once (U4)."""
    return listing.where("artifact <> 'progress'").select("stem").distinct()


def readiness(listing: DataFrame) -> DataFrame:
    """Which artifacts each stem has, and the time of the newest."""
    return listing.groupBy("stem").agg(*(F.bool_or(F.col("artifact") == k).alias(f"{k}_ready") for k in [*ARTIFACTS, "frames"]), F.max("modificationTime").alias("updated_at"))


def objects(spark: SparkSession, prefix: str) -> DataFrame:
    """path, length and modificationTime of every object below a prefix, in any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(prefix).select("path", "length", "modificationTime")


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an object is there."""
    fs, p = _at(spark, path)
    return fs.exists(p)


def put(spark: SparkSession, local: str, path: str) -> str:
    """A local file as an object."""
    fs, p = _at(spark, path)
    fs.copyFromLocalFile(False, True, spark._jvm.org.apache.hadoop.fs.Path(local), p)
    return path


def delete_prefix(spark: SparkSession, folder: str, prefix: str) -> int:
    """How many objects below a folder were deleted whose name begins with the prefix (S10). Only paths reach the driver's listing."""
    fs, p = _at(spark, folder)
    found = list(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, f"{prefix}*")) or [])
    return sum(bool(fs.delete(f.getPath(), True)) for f in found)


def read_json(spark: SparkSession, path: str, artifact: str, schema: str, shards: int = 1) -> DataFrame:
    """JSON artifacts of a kind with their stem (S7); a file that isn't valid has null columns."""
    rows = artifact_files.read_artifacts(spark, path, shards).where(F.col("artifact") == artifact)
    told = F.from_json(F.col("content").cast("string"), schema)
    return rows.select("stem", told.alias("_j")).select("_j.*", "stem")


def write_json(rows: DataFrame, path: str, artifact: str, by: str = "stem", shards: int = 1) -> None:
    """Each row as the JSON object of its other columns, in a file named by its stem."""
    told = F.to_json(F.struct(*(c for c in rows.columns if c != by)), {"ignoreNullFields": "false"})
    artifact_files.write_artifacts(rows.select(F.col(by).alias("stem"), F.lit(artifact).alias("artifact"), told.alias("content")), path, shards)


def write_transcript_files(transcripts: DataFrame, path: str, shards: int = 1) -> None:
    """Each transcript (stem, full_text and others) as `<stem>_transcript.txt` and `<stem>_transcript.json`."""
    told = F.to_json(F.struct(*(c for c in transcripts.columns if c != "stem")), {"ignoreNullFields": "false"})
    both = F.array(F.struct(F.lit("transcript_txt").alias("artifact"), F.col("full_text").alias("content")), F.struct(F.lit("transcript_json").alias("artifact"), told.alias("content")))
    artifact_files.write_artifacts(transcripts.select("stem", F.explode(both).alias("f")).select("stem", "f.*"), path, shards)


def write_transcripts(transcripts: DataFrame, path: str, files: int | None = None) -> None:
    """Transcripts as JSON lines with the medium's id (S15), in files that share media; text_of() gives one as text."""
    columns = [c for c in ("media_id", "language", "full_text", "segments") if c in transcripts.columns]
    rows = transcripts.select(*columns)
    (rows.repartitionByRange(files, "media_id") if files else rows).write.mode("overwrite").json(path)


def text_of(spark: SparkSession, path: str, media_id: int) -> DataFrame:
    """The transcript of a medium as a line of text."""
    return spark.read.schema("media_id long, full_text string").json(path).where(F.col("media_id") == media_id).select(F.col("full_text").alias("value"))


def video_metadata(files: DataFrame, probe: Callable[[bytes], dict]) -> DataFrame:
    """path with fps, frames, width, height, codec and duration, told by the probe (S11); null where it fails."""
    fields = {"fps": float, "frames": int, "width": int, "height": int, "codec": str, "duration_sec": float}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    found = probe(content)
                except Exception:  # noqa: BLE001  a file that can't be probed has no figures
                    found = {}
                rows.append([path, *(found.get(k) for k in fields)])
            yield pd.DataFrame(rows, columns=["path", *fields])

    return files.select("path", "content").mapInPandas(run, "path string, fps double, frames long, width long, height long, codec string, duration_sec double")
