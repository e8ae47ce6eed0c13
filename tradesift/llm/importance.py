"""Target-distribution importance resampling on hashed word n-grams.

Features of a text are all runs of 1 to ``longest`` consecutive words. A feature's bucket is the CRC-32 of its words joined
by single spaces, modulo ``buckets``. Each different word's CRC is computed once; that of a longer run is composed of its
words' CRCs: appending n bytes multiplies a CRC by a 32 x 32 matrix over GF(2), and matrices of powers of two bytes give
every n. No n-gram is ever put together as a string.

``importance`` counts buckets over all of the source and all of the target, gives every bucket a gain (the log ratio of
its smoothed shares in thousandths, floored), every document the floored mean gain of its features, and draws the highest
sums of mean and Gumbel noise, which is sampling without replacement in proportion to the ratio. The noise is a hash of
the document's id, so reruns agree.

What goes through the driver: one count for each bucket, a number fixed by ``buckets``. Ranks need no global sort: scores
are whole numbers within some ten thousands of zero, so documents are counted by score, and only those that tie are
ordered, score by score.

Defined cases: null text has no words; a text without features has weight 0; a null doc_id hashes as the empty string and
comes last among ties; rows that repeat a doc_id are rows like others; without eligible documents nothing is drawn; an
empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradesift.llm.bpe import pieces
from tradesift.llm.common import materialise, text_of

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
#: Share of the eligible documents that is drawn, as a fraction.
SHARE = (10, 100)
#: Words that a task remembers the CRC of.
REMEMBERED = 200_000
MOST_BUCKETS = 1 << 20
#: What separates words becomes a space, A-Z become small; bytes of letters beyond ASCII stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
POLYNOMIAL = 0xEDB88320


def _columns_of_one_byte() -> list[int]:
    """What appending a zero byte makes of each of the 32 bits."""
    out = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (POLYNOMIAL if c & 1 else 0)
        out.append(c)
    return out


def _times(columns: list[int], c: int) -> int:
    out = 0
    for bit, column in enumerate(columns):
        if c >> bit & 1:
            out ^= column
    return out


class Shift:
    """Multiplies CRCs by the matrix of appending any number of zero bytes, many at a time."""

    def __init__(self) -> None:
        self.columns = [_columns_of_one_byte()]
        self.tables: list[np.ndarray] = []

    def table(self, power: int) -> np.ndarray:
        """The matrix of 2 ** power bytes as four tables, one for each byte of a CRC."""
        while len(self.columns) <= power:
            self.columns.append([_times(self.columns[-1], c) for c in self.columns[-1]])
        while len(self.tables) <= power:
            columns = self.columns[len(self.tables)]
            self.tables.append(np.array([[_times(columns, v << 8 * b) for v in range(256)] for b in range(4)], np.uint32))
        return self.tables[power]

    def __call__(self, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        crc, power = crc.copy(), 0
        while len(use := np.flatnonzero(size >> power)):
            use = use[(size[use] >> power) & 1 == 1]
            t, c = self.table(power), crc[use]
            crc[use] = t[0][c & 255] ^ t[1][c >> 8 & 255] ^ t[2][c >> 16 & 255] ^ t[3][c >> 24]
            power += 1
        return crc


class Features:
    """CRCs of the features of texts; one for each task."""

    def __init__(self, longest: int):
        self.longest, self.shift = longest, Shift()
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.crc, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all texts' words, and how many each text has."""
        if len(self.index) > REMEMBERED:
            self.forget()
        split = [t.translate(FOLD).split() for t in texts]
        index = self.index
        fresh = [w for w in set().union(*split) if w not in index]
        if fresh:
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
            self.crc = np.concatenate((self.crc, np.fromiter(map(zlib.crc32, fresh), np.uint32, len(fresh))))
            self.size = np.concatenate((self.size, np.fromiter(map(len, fresh), np.int64, len(fresh))))
        counts = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter((index[w] for words in split for w in words), np.int64, int(counts.sum())), counts

    def __call__(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of run: the CRCs, and how many each text has; first words, then pairs, and so on."""
        words, counts = self.words(texts)
        ends = np.repeat(np.cumsum(counts), counts)
        crc, size = self.crc[words], self.size[words]
        yield crc, counts
        if self.longest == 1:
            return
        spaced = self.shift(np.full(len(crc), zlib.crc32(b" "), np.uint32), size) ^ crc
        start = np.arange(len(crc))
        for more in range(1, self.longest):
            inside = start + more < ends[start]
            crc, start = crc[inside], start[inside]
            last = start + more
            crc = self.shift(crc, size[last] + 1) ^ spaced[last]
            yield crc, np.maximum(counts - more, 0)


def bucket_counts(df: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into it. A task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(longest), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in pieces(batch.column(0), raw=True):
                for crc, _ in features(texts):
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    return df.select(text_of().alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths."""
    if not 0 < buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}: their counts go through the driver")
    s, t = ({r["bucket"]: r["n"] for r in bucket_counts(df, longest, buckets).collect()} for df in (source, target))
    in_s, in_t = sum(s.values()), sum(t.values())
    return np.array([math.floor(1000 * math.log((t.get(b, 0) + 1) * float(in_s + buckets) / ((s.get(b, 0) + 1) * float(in_t + buckets)))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight: one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, gain = Features(longest), given.value
        for batch in batches:
            for a, texts in pieces(batch.column(1), raw=True):
                n, total, n_words = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), None
                for crc, counts in features(texts):
                    sums = np.concatenate(([0], np.cumsum(gain[crc % np.uint32(len(gain))])))
                    ends = np.cumsum(counts)
                    n, total, n_words = n + counts, total + sums[ends] - sums[ends - counts], counts if n_words is None else n_words
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array(n_words), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``scored`` with rank: of the documents with ``least_words`` the highest scores, ties to smaller doc_id; null if not
    drawn. ``scored`` is read several times, so it should be stored."""
    eligible = F.col("n_words") >= least_words
    # One row for each score that occurs: whole numbers, within some ten thousands of zero whatever the corpus.
    counts = scored.filter(eligible).groupBy("score").agg(F.count("*").alias("n"))
    levels = counts.select(
        F.col("score").alias("_level"), (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("_above"), F.expr(f"sum(n) OVER () * {share[0]} div {share[1]}").alias("_quota")
    )
    placed = scored.join(F.broadcast(levels), eligible & (F.col("score") == F.col("_level")), "left")
    high = placed.filter("_above < _quota")
    rank = F.col("_above") + F.row_number().over(Window.partitionBy("_level").orderBy(F.asc_nulls_last("doc_id")))
    high = high.withColumn("rank", F.when(rank <= F.col("_quota"), rank.cast("long")))
    low = placed.filter("_above IS NULL OR _above >= _quota").withColumn("rank", F.lit(None).cast("long"))
    return high.unionByName(low).select(*scored.columns, "rank")


def importance(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per row of ``docs``."""
    weighed = weights(docs, gains(docs, target, longest, buckets), longest)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return drawn(materialise(weighed.withColumn("score", F.col("weight") + noise), "scored"), least_words, share)
