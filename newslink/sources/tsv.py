"""Article tables as xz-compressed TSV files, one task for each file."""

from __future__ import annotations

import csv
import io
import lzma
import posixpath
import sys
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from newslink.sources.storage import shared_dir


COLUMNS = ("id", "pubtime", "medium_code", "medium_name", "char_count", "head", "article_link", "content_id", "content")


#: Effort of the xz writer: higher ones take several times as long for somewhat smaller files.
PRESET = 0


def read_xz(spark: SparkSession, folder: str) -> DataFrame:
    """All *.tsv.xz files of a folder; header names are stripped, missing columns are null, all values strings."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tsv.xz").load(folder).select("content")
    if files.limit(1).count() == 0:
        raise FileNotFoundError(f"no *.tsv.xz file in {folder}")

    def parse(batches):
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for content in batch["content"]:
                lines = io.TextIOWrapper(lzma.open(io.BytesIO(content)), encoding="utf-8", newline="")
                rows = csv.reader(lines, delimiter="\t")
                names = [x.strip() for x in next(rows, [])]
                place = {name: i for i, name in enumerate(names)}
                at = [place.get(c, sys.maxsize) for c in COLUMNS]
                part = []
                for row in rows:
                    n = len(row)
                    part.append([row[i] or None if i < n else None for i in at])
                    if len(part) == 1000:
                        yield pd.DataFrame(part, columns=list(COLUMNS))
                        part = []
                yield pd.DataFrame(part, columns=list(COLUMNS), dtype=object)

    return files.mapInPandas(parse, ", ".join(f"{c} string" for c in COLUMNS))


def write_xz(df: DataFrame) -> str:
    """Write one *.tsv.xz file for each partition in a new shared folder; returns the folder."""
    folder = shared_dir(df.sparkSession, "tsv")
    names = df.columns

    def write(batches):
        import pyarrow.fs as pafs

        fs, path = (pafs.LocalFileSystem(), urlsplit(folder).path) if urlsplit(folder).scheme in ("", "file") else pafs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        context = TaskContext.get()
        target = posixpath.join(path, f"part-{context.partitionId():05d}")
        with fs.open_output_stream(f"{target}.{context.taskAttemptId()}") as out, lzma.open(out, "wt", preset=PRESET, encoding="utf-8", newline="") as file:
            rows = csv.writer(file, delimiter="\t")
            rows.writerow(names)
            n = 0
            for batch in batches:
                batch = batch.astype(object).where(batch.notna(), None)
                rows.writerows(batch.itertuples(index=False))
                n += len(batch)
        fs.move(f"{target}.{context.taskAttemptId()}", f"{target}.tsv.xz")
        yield pd.DataFrame({"n": [n]})

    df.mapInPandas(write, "n bigint").count()
    return folder
