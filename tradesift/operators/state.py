"""State tables: pure functions (state, delta) -> new state, and a store of Parquet folders behind one pointer.

A table is a list of folders: a base and what was appended since. New folders are written beside those in use, and one
new pointer file then makes all tables of a commit current at once. A reader never sees a half-written table, no query
overwrites the path it reads, and a run that dies before its commit leaves the state as it was."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.config import DEFAULT, Config
from tradesift.operators import numbering
from tradesift.operators.dedup import cut, first_of


def insert_absent(state: DataFrame, delta: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """First writer wins; within the delta the first in ``order``."""
    fresh = first_of(delta, key, *order).join(state.select(*key), key, "left_anti")
    return state.unionByName(fresh.select(*state.columns))


def replace(state: DataFrame, delta: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last writer wins by ``version``; a delta row wins over an equally old state row."""
    both = state.withColumn("_new", F.lit(0)).unionByName(delta.select(*state.columns).withColumn("_new", F.lit(1)))
    return first_of(both, key, F.col(version).desc(), F.col("_new").desc()).drop("_new")


def upsert(state: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Delta rows (one for each key) take the place of state rows."""
    return state.join(delta.select(*key), key, "left_anti").select(*delta.columns).unionByName(delta)


def enqueue_retries(state: DataFrame, failures: DataFrame, as_of: Column) -> DataFrame:
    """Attempts count up, the first failure's time stays, and stage 2 is never taken back to stage 1.
    ``failures``: item_id, stage; one row for each failed attempt."""
    new = failures.groupBy("item_id").agg(F.max("stage").alias("new_stage"), F.count("*").cast("int").alias("n"))
    stage = F.when((F.col("stage") == "stage2") | (F.col("new_stage") == "stage2"), "stage2").otherwise(F.coalesce("new_stage", "stage"))
    failed = F.col("n").isNotNull()
    return state.join(new, "item_id", "full_outer").select(
        "item_id",
        stage.alias("stage"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("attempts"),
        F.coalesce("first_failed_at", as_of).alias("first_failed_at"),
        F.when(failed, as_of).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
    )


def delete_keys(state: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return state.join(keys.select(*key).distinct(), key, "left_anti").select(*state.columns)


def prune(state: DataFrame, column: str, as_of: Column, days: int) -> DataFrame:
    return state.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days)))


def expire_retries(queue: DataFrame, items: DataFrame, as_of: Column, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(expired rows with their items, the queue that is left). Rows whose item is gone leave the queue unreported."""
    over = (F.col("attempts") >= config.retry_attempts) | (F.col("first_failed_at") < as_of - F.make_dt_interval(F.lit(0), F.lit(config.retry_hours)))
    known = items.withColumnRenamed("id", "item_id")
    return queue.filter(over).join(known, "item_id"), queue.filter(~over).join(known.select("item_id"), "item_id", "left_semi")


def pending_retries(queue: DataFrame, items: DataFrame, stage: str) -> DataFrame:
    return queue.filter(F.col("stage") == stage).join(items.withColumnRenamed("id", "item_id"), "item_id").orderBy("first_failed_at", "item_id")


def queue_size(queue: DataFrame) -> int:
    return queue.count()


def distinct_people(sales: DataFrame) -> DataFrame:
    """person_key, company_key, n: the people and companies that sales name, with how often each pair occurs."""
    return sales.filter("person_key <> '' AND company_key <> ''").groupBy("person_key", "company_key").agg(F.count("*").alias("n"))


def update_columns(state: DataFrame, delta: DataFrame, key: str, columns: list[str], as_of: Column) -> DataFrame:
    """Delta columns that are not null replace the state's; updated_at of touched rows is ``as_of``."""
    d = delta.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = state.join(d, F.col(key) == F.col("_k"), "left")
    touched = {c: F.coalesce(f"_{c}", c) for c in columns} | {"updated_at": F.when(F.col("_k").isNotNull(), as_of).otherwise(F.col("updated_at"))}
    return joined.select(*[touched.get(c, F.col(c)).alias(c) for c in state.columns])


def with_ids(state: DataFrame, rows: DataFrame, *order: str) -> DataFrame:
    """Rows numbered from the state's largest id on, densely and in order."""
    top = state.agg(F.max("id")).first()[0] or 0
    placed = numbering.numbered(rows, [F.col(c) for c in order], cut, "_place")
    return placed.withColumn("id", (F.col("_place") + F.lit(top) + 1).cast("long")).drop("_place")


def lookup_fresh(keys: DataFrame, cache: DataFrame, key: str, as_of: Column, ttl_days: int) -> DataFrame:
    """Left as-of join: the newest cached row of each key that is not over its time."""
    fresh = first_of(cache.filter(F.col("fetched_at") >= as_of - F.make_dt_interval(F.lit(ttl_days))), [key], F.col("fetched_at").desc())
    return keys.join(fresh, key, "left")


class StateStore:
    """Named tables under a root folder that all executors reach. One writer at a time."""

    #: Appended folders of a table, beyond which a commit writes it anew.
    MOST_PARTS = 24

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _current(self) -> tuple[int, dict[str, list[str]]]:
        """Number of the last commit, and the folders of each table."""
        fs, folder = self._files(f"{self.root}/commits")
        if not fs.exists(folder):
            return 0, {}
        numbers = [int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()]
        if not numbers:
            return 0, {}
        top = max(numbers)
        return top, json.loads(self.spark.read.text(f"{self.root}/commits/{top}", wholetext=True).first()[0])

    def version(self, name: str) -> int:
        """Folders that the table has had so far; 0 for a table never written."""
        parts = self._current()[1].get(name)
        return int(parts[-1].rsplit("-", 1)[1]) if parts else 0

    def read(self, name: str) -> DataFrame:
        parts = self._current()[1].get(name)
        if not parts:
            return schemas.empty(self.spark, name)
        tables = [schemas.conform(self.spark.read.parquet(f"{self.root}/{p}"), schemas.STATE[name]) for p in parts]
        return functools.reduce(DataFrame.unionByName, tables)

    def commit(self, replaced: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
        """All tables of both at once: ``replaced`` anew, ``added`` as further rows. The new commit's number."""
        number, tables = self._current()
        run = uuid.uuid4().hex[:8]

        def folder(name: str) -> str:
            return f"{name}/{run}-{self._next(tables.get(name))}"

        now = dict(tables)
        for name, df in replaced.items():
            now[name] = [self._put(folder(name), name, df)]
        for name, df in (added or {}).items():
            if name in replaced:
                raise ValueError(f"{name} is both replaced and appended to")
            parts = tables.get(name, [])
            if len(parts) >= self.MOST_PARTS:
                now[name] = [self._put(folder(name), name, self.read(name).unionByName(schemas.conform(df, schemas.STATE[name])))]
            else:
                now[name] = [*parts, self._put(folder(name), name, df)]
        fs, draft = self._files(f"{self.root}/commits/.{number + 1}-{run}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        if not fs.rename(draft, self._files(f"{self.root}/commits/{number + 1}")[1]):
            raise RuntimeError("another writer has committed")
        return number + 1

    @staticmethod
    def _next(parts: list[str] | None) -> int:
        return int(parts[-1].rsplit("-", 1)[1]) + 1 if parts else 1

    def _put(self, folder: str, name: str, df: DataFrame) -> str:
        schemas.conform(df, schemas.STATE[name]).write.parquet(f"{self.root}/{folder}")
        return folder

    def write(self, name: str, df: DataFrame) -> int:
        self.commit({name: df})
        return self.version(name)

    def append(self, name: str, rows: DataFrame) -> int:
        self.commit({}, {name: rows})
        return self.version(name)

    def get(self, key: str) -> str | None:
        row = self.read("kv_state").filter(F.col("key") == key).select("value").first()
        return row[0] if row else None

    def values(self, changes: dict[str, str]) -> DataFrame:
        """kv_state with ``changes``, for a commit together with other tables."""
        return upsert(self.read("kv_state"), self.spark.createDataFrame(list(changes.items()), schemas.STATE["kv_state"]), ["key"])

    def put(self, key: str, value: str) -> None:
        self.commit({"kv_state": self.values({key: value})})
