"""CSV lists and the outbox of messages."""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> None:
    """UTF-8 with header, quoted only where needed, missing and empty text both blank.

    Every task writes its own part; parts are in the order of ``df``.
    """
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def safe_name(text: str, length: int = 30) -> str:
    """A name of one folder: the head of the text to read, a digest of all of it to tell names apart."""
    head = re.sub(r"[^\w-]+", "_", text)[:length].strip("_")
    return f"{head}_{hashlib.sha256(text.encode()).hexdigest()[:8]}"


def campaign_file_name(tag: str, as_of: date) -> str:
    return f"{safe_name(tag)}_{as_of:%Y%m%d}"


def segment_file_name(segment: str) -> str:
    return f"rfm_{safe_name(segment.lower())}"


# an outbox: messages in run_date=<day>/version=<version>/, and for each version that counts an empty file
# _commits/run_date=<day>/<number>.<version>, of which the last by name says what the day's messages are
_COMMITS = "_commits"


def write_outbox(messages: DataFrame, path: str, as_of: date) -> None:
    """Replace the messages of one day, also by none at all, and touch no other day.

    Messages of any other day are an error. They are written as a new version of the day, which
    counts from the moment its commit record appears: one empty file, created in one step on every file
    system, nothing is renamed. A run that fails before leaves the day as it was, one that fails
    later leaves the new day; :func:`read_outbox` reads the one or the other. Versions that an earlier
    commit named are deleted last.
    """
    if not messages.filter(~F.col("run_date").eqNullSafe(F.lit(as_of))).isEmpty():
        raise ValueError(f"there are messages of other days than {as_of:%Y-%m-%d}")
    outbox = _Outbox(messages.sparkSession, path)
    before = outbox.commits(as_of)
    version = uuid.uuid4().hex
    messages.drop("run_date").write.parquet(outbox.version(as_of, version))
    number = int(before[-1].partition(".")[0]) + 1 if before else 1
    outbox.commit(as_of, f"{number:012d}.{version}")
    outbox.forget(as_of, before)


def read_outbox(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Messages of all days as last committed, with their ``run_date``.

    Without any committed day an error, or an empty table if ``schema`` (of the messages) is given.
    """
    outbox = _Outbox(spark, path)
    current = [outbox.version(day, outbox.commits(day)[-1].partition(".")[2]) for day in outbox.days()]
    if not current and schema is None:
        raise FileNotFoundError(f"no day was ever committed to {path}")
    if not current:
        return spark.createDataFrame([], schema)
    # folder names, read whatever the session makes of them
    df = spark.read.option("basePath", path).parquet(*current).drop("version")
    return df.select(F.col("run_date").cast("date").alias("run_date"), *(c for c in df.columns if c != "run_date"))


def clean_outbox(spark: SparkSession, path: str, older_than_hours: float = 24) -> None:
    """Delete versions that no commit names, left by runs that failed, once they are that old."""
    outbox = _Outbox(spark, path)
    outbox.sweep(time.time() * 1000 - older_than_hours * 3_600_000)


class _Outbox:
    """Folders and commit records of an outbox."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self.path, self._new = path, jvm.org.apache.hadoop.fs.Path
        self._files = self._new(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, day: date) -> str:
        return f"run_date={day:%Y-%m-%d}"

    def _names(self, path: str) -> list[str]:
        folder = self._new(path)
        if not self._files.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in self._files.listStatus(folder))

    def version(self, day: date, version: str) -> str:
        return f"{self.path}/{self._folder(day)}/version={version}"

    def days(self) -> list[date]:
        """Days with a commit: one folder for each day that the job has run."""
        found = [date.fromisoformat(n.removeprefix("run_date=")) for n in self._names(f"{self.path}/{_COMMITS}") if n.startswith("run_date=")]
        return [day for day in found if self.commits(day)]

    def commits(self, day: date) -> list[str]:
        """Names of the day's commit records, the one that counts last."""
        return [n for n in self._names(f"{self.path}/{_COMMITS}/{self._folder(day)}") if "." in n and n[0].isdigit()]

    def commit(self, day: date, name: str) -> None:
        record = self._new(f"{self.path}/{_COMMITS}/{self._folder(day)}/{name}")
        self._files.create(record, False).close()

    def forget(self, day: date, commits: list[str]) -> None:
        """Drop earlier versions: what they hold first, then their records, so that a rerun finds what is left."""
        for name in commits:
            self._files.delete(self._new(self.version(day, name.partition(".")[2])), True)
            self._files.delete(self._new(f"{self.path}/{_COMMITS}/{self._folder(day)}/{name}"), False)

    def sweep(self, before_ms: float) -> None:
        for folder in self._names(self.path):
            if not folder.startswith("run_date="):
                continue
            day = date.fromisoformat(folder.removeprefix("run_date="))
            named = {n.partition(".")[2] for n in self.commits(day)}
            for version in self._names(f"{self.path}/{folder}"):
                at = self._new(f"{self.path}/{folder}/{version}")
                if version.removeprefix("version=") not in named and self._files.getFileStatus(at).getModificationTime() < before_ms:
                    self._files.delete(at, True)
