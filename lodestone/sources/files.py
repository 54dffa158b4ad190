"""File sources: tolerant JSON lines, verified manifests, sniffed binaries, archives. All go through
Spark's readers, so any store that Spark reads will do."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of a JSON lines folder: malformed lines and lines without the key go, and of several
    lines with one key the last stays, by file name and then by place in it."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    fields = StructType.fromDDL(schema)
    broken = "_broken"
    parsed = F.from_json("value", fields.add(broken, "string"), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken})
    good = lines.select("file", "place", parsed.alias("r")).where(F.col(f"r.{broken}").isNull() & F.col(f"r.{key}").isNotNull())
    # numbers rise within a partition, and a partition reads a file's lines in order
    latest = good.groupBy(F.col(f"r.{key}").alias("k")).agg(F.max_by("r", F.struct("file", "place")).alias("r"))
    return latest.select("r.*").drop(broken)


def verified_manifest(entries: DataFrame, files: DataFrame, path: str = "path", digest: str = "sha256") -> DataFrame:
    """Manifest rows with their content; a missing file or another digest fails the job."""
    found = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("__name"), "content")
    rows = entries.join(found, F.col(path) == F.col("__name"), "left")
    same = F.sha2("content", 256) == F.col(digest)
    problem = F.concat(F.lit("digest of "), F.col(path), F.lit(" differs or the file is missing"))
    checked = F.when(F.coalesce(same, F.lit(False)), F.col("content")).otherwise(F.raise_error(problem).cast("binary"))
    return rows.withColumn("content", checked).drop("__name")


def _number(c: str, at: int, size: int, little: bool = False) -> Column:
    digits = F.hex(F.substring(c, at, size))
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])
    return F.conv(digits, 16, 10).cast("int")


def sniffed(files: DataFrame) -> DataFrame:
    """Kind and pixel size of binary files from their first bytes; null where unknown."""
    head = F.hex(F.substring("content", 1, 12))
    text = F.lower(F.decode(F.substring("content", 1, 256), "ISO-8859-1"))
    kind = (
        F.when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & head.endswith("57454250"), "image/webp")
        .when(head.startswith("5035"), "image/x-portable-graymap")
        .when(text.contains("<svg"), "image/svg+xml")
    )
    rows = files.withColumn("kind", kind)
    width = F.when(F.col("kind") == "image/png", _number("content", 17, 4)).when(F.col("kind") == "image/gif", _number("content", 7, 2, True))
    height = F.when(F.col("kind") == "image/png", _number("content", 21, 4)).when(F.col("kind") == "image/gif", _number("content", 9, 2, True))
    return rows.withColumns({"width": width, "height": height})


def archive_members(files: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """(path, member, content) of the regular files in tar archives, read one member at a time; a
    member over ``most_bytes`` fails rather than fill a task."""
    schema = pa.schema([("path", pa.string()), ("member", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py())) as archive:
                    for member in archive:
                        if not member.isfile():
                            continue
                        if member.size > most_bytes:
                            raise ValueError(f"{member.name} has {member.size} bytes; the bound is {most_bytes}")
                        data = archive.extractfile(member).read()
                        yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([member.name]), pa.array([data], pa.binary())], schema=schema)

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")
