"""Results as files: one line of status, tables of findings, Markdown by document and chapter."""

from __future__ import annotations

from datetime import datetime
from itertools import chain, count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status(counts: DataFrame) -> DataFrame:
    """A one-row table as one line of k=v in ASCII."""
    pairs = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in counts.columns]
    return counts.select(F.concat_ws(" ", *pairs).alias("status"))


def write_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header; tabs and newlines in text become spaces."""
    clean = {c: F.regexp_replace(c, r"[\t\r\n]", " ") for c, kind in rows.dtypes if kind == "string"}
    rows.withColumns(clean).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(path)


def write_findings(rows: DataFrame, path: str, folders: bool = False) -> None:
    """Rows as JSON lines, those of a document together; on request a folder for each document."""
    writer = rows.repartition("doc_id").sortWithinPartitions("doc_id").write.mode("overwrite")
    (writer.partitionBy("doc_id") if folders else writer).json(path)


def _line(rows: DataFrame) -> Column:
    """The text without its last newline, which the writer adds."""
    return F.regexp_replace(rows["text"], r"\n\z", "").alias("text")


def write_documents(rows: DataFrame, path: str) -> None:
    """doc_id, text: a folder for each document; a file ends with one newline at least."""
    rows.select("doc_id", _line(rows)).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_chapters(files: DataFrame, path: str) -> None:
    """A folder for each document and file."""
    files.select("doc_id", "file", _line(files)).write.mode("overwrite").partitionBy("doc_id", "file").text(path)


def write_report(rows: DataFrame, folder: str, at: datetime) -> str:
    """Rows as JSON lines under a name with the time, never over an earlier report; the path."""
    path = f"{folder.rstrip('/')}/report-{at:%Y%m%d-%H%M%S}"
    paths = rows.sparkSession._jvm.org.apache.hadoop.fs
    taken = lambda p: paths.Path(p).getFileSystem(rows.sparkSession._jsparkSession.sessionState().newHadoopConf()).exists(paths.Path(p))
    free = next(p for p in chain([path], (f"{path}-{k}" for k in count(2))) if not taken(p))
    rows.write.json(free)
    return free
