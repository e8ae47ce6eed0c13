"""Helpers that the training-data operators share: table access, let-binding, scratch tables in the shared folder."""

from __future__ import annotations

import contextlib
import contextvars
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.operators.dedup import shared_folder

#: White space of every contract here: space and \x09-\x0D, nothing else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Tables written in the current ``scratch`` block; folders that go with the application.
_scratch: contextvars.ContextVar[list[str]] = contextvars.ContextVar("scratch", default=[])
_roots: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``; the optimizer cannot inline it into inner lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast built-in; other text is translated letter by letter."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """Maximal runs outside SPACE, in order. Plain replacements and a one-byte split stay off the regex engine."""
    for white in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode (tests)."""
    return shared_folder(spark)


def unique() -> str:
    return uuid.uuid4().hex


def _path(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def app_root(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    root = f"{shared_dir(spark)}/tradesift/{spark.sparkContext.applicationId}"
    if root not in _roots:
        _roots.add(root)
        fs, target = _path(spark, root)
        fs.deleteOnExit(target)
    return root


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder for a table of this application. The enclosing ``scratch`` block deletes it, or the end of the
    application."""
    path = f"{app_root(spark)}/{what}-{unique()}"
    _scratch.get().append(path)
    return path


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """A file in this application's folder: written beside its name, then renamed, so it is whole where it can be seen."""
    path = f"{app_root(spark)}/files/{name}"
    fs, target = _path(spark, path)
    if not fs.exists(target):
        _, draft = _path(spark, f"{path}-{unique()}")
        out = fs.create(draft, True)
        out.write(bytearray(data))
        out.close()
        if not fs.rename(draft, target) and not fs.exists(target):
            raise OSError(f"could not write {path}")
    return path


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing written."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, target = _path(spark, path)
    fs.delete(target, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes inside the block, and only those, are deleted at its end. For callers that have
    stored every result built on them by then. Blocks of other threads or runs are not touched."""
    mine: list[str] = []
    token = _scratch.set(mine)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in mine:
            delete_path(spark, path)
