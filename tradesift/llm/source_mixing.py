"""Mixing sources to target weights by systematic sampling.

Each source gets a target of words by weight, at most ``max_repeat`` times its size; what a capped source cannot take is
shared again by weight among the rest. A document of a source is expected rate = target/size times. Documents are laid in
a fixed order, their expected copies are prefix-summed from one hashed offset per source, and a document is emitted once
for each integer boundary its interval crosses, so none is emitted more than ceil(rate) times, and over all offsets each
is emitted rate times on average.

The order is by size class (an eighth of a doubling), then by hash. The boundaries crossed by any prefix of the order
differ from its expected copies by less than one, so with sizes in order a source's taken words miss its target by no more
than its longest document and the spread inside the classes; a long document that is or isn't repeated is the one thing
that no offset can even out.

The prefix sum is two-level: slices of a bounded number of documents are summed, the sums are added up over slices, and
ranks inside a slice come from a window on that slice alone, so a source that holds a third of all rows is spread out.
Sources are numbered, and their caps summed up, over range partitions: there may be as many as hosts.

Defined cases: null text counts zero words; a null source is a source of its own, weighed last; sources without words
get target zero and take nothing; repeated rows are separate documents, of which each takes its own copies; an empty
table gives an empty result. Only doc_id, text and source are read by ``mix``. ``repeat_documents`` tells rows that tie in
doc_id, source and size apart by a hash of text and all other columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradesift.llm.common import materialise, text_of, words_of
from tradesift.operators.numbering import numbered, running

WEIGHTS = (5, 2, 1)
#: The share of all words that is taken, as a fraction, and the most times a source repeats.
SHARE = (3, 2)
MAX_REPEAT = 2
SLICE_ROWS = 20_000
SEED = 20240229


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words_of(text_of())).cast("long").alias("size"), *more)


def row_key(docs: DataFrame) -> Column:
    """A hash of a whole row: equal for rows that agree in every column, a null text and an empty one being different."""
    others = F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != "text"])
    return F.xxhash64(docs["text"], docs["text"].isNull(), F.to_json(others))


def digits(value: Column, n: int) -> Column:
    """The first ``n`` hexadecimal digits of a text's MD5 as a number."""
    return F.conv(F.substring(F.md5(value), 1, n), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size -> with target. In the order of cap per weight the capped sources are a prefix, so one running
    sum over the sources finds the level that the others share at."""
    up, down = share
    store = lambda df: materialise(df, "sources")
    placed = numbered(sources, [F.col("source")], store)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    weighed = placed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeat)
    ratio = F.col("cap").cast("double") / F.col("weight")
    summed = running(weighed, [ratio, F.col("source")], {"cap_before": F.col("cap"), "weight_before": F.col("weight")}, store)
    size, weights_sum = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    # The level that weights would share at; a source is capped while that level reaches its cap per weight.
    level = (F.lit((size or 0) * up) - F.col("cap_before") * down).cast("double") / ((F.lit(weights_sum or 0) - F.col("weight_before")) * down).cast("double")
    level = summed.withColumn("level", level).withColumn("capped", F.col("level") >= ratio)
    level = level.withColumn("at", F.struct(ratio.alias("r"), F.col("source").isNull().alias("z"), F.col("source").alias("s"), "level"))
    shared = level.agg(F.min(F.when(~F.col("capped"), F.col("at")))["level"]).first()[0]
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(shared)).alias("target"))


def size_class() -> Column:
    """Eighths of a doubling, in whole numbers: the bits of the size, then the next three bits."""
    return F.when(F.col("size") > 0, F.expr("length(bin(size)) * 8 + shiftright(size * 8, length(bin(size)) - 1)")).otherwise(F.lit(0)).cast("int")


def offset(seed: int) -> Column:
    """One offset in [0, 1) for each source: 52 bits of a hash."""
    return digits(F.concat_ws(":", F.lit(str(seed)), F.col("source").isNull().cast("int").cast("string"), F.coalesce("source", F.lit(""))), 13).cast("double") / float(1 << 52)


def mix(docs: DataFrame, slice_rows: int = SLICE_ROWS, seed: int = SEED, **kinds) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    return mix_sized(sized(docs), slice_rows, seed, **kinds)


def mix_sized(docs: DataFrame, slice_rows: int = SLICE_ROWS, seed: int = SEED, **kinds) -> DataFrame:
    """``mix`` of what ``sized`` returns; further columns are carried along and order rows that tie."""
    more = docs.columns[3:]
    x = digits(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 15)
    base = materialise(docs.withColumn("class", size_class()).withColumn("x", x), "sized")
    classes = base.groupBy("source", "class").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    share = targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), **kinds)
    share = share.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    cut = classes.select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.ceil(F.col("rows") / slice_rows).cast("long").alias("slices"))
    laid = base.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")))
    laid = laid.select("doc_id", "source", "size", *more, "class", "x", F.floor(F.shiftright("x", 29) * F.col("slices") / float(1 << 31)).alias("slice"))
    parts = laid.groupBy("source", "class", "slice").agg(F.count("*").alias("rows"))
    # Slices of one source: its documents over slice_rows, and its size classes.
    parts = parts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("source").orderBy("class", "slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    share = share.withColumnRenamed("source", "s_source")
    parts = parts.join(share, F.col("source").eqNullSafe(F.col("s_source"))).select(F.col("source").alias("p_source"), F.col("class").alias("p_class"), F.col("slice").alias("p_slice"), "before", "source_size", "target", "rate")
    rank = F.row_number().over(Window.partitionBy("source", "class", "slice").orderBy("x", "doc_id", "size", *more))
    ranked = laid.withColumn("rank", rank)
    placed = ranked.join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("class") == F.col("p_class")) & (F.col("slice") == F.col("p_slice")))
    end, u = F.col("before") + F.col("rank"), offset(seed)
    copies = F.floor(end * F.col("rate") + u) - F.floor((end - 1) * F.col("rate") + u)
    return placed.withColumn("copies", copies.cast("long")).select("doc_id", "source", "size", *more, "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, slice_rows: int = SLICE_ROWS, seed: int = SEED, **kinds) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it, with their columns. Rows that agree in every column
    are emitted through one of them, as many times as all of them together."""
    names = docs.columns
    taken = mix_sized(sized(docs, row_key(docs).alias("row_key")), slice_rows, seed, **kinds)
    key = ["_id", "_source", "_size", "_key"]
    copies = taken.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("row_key").alias("_key")).agg(F.sum("copies").alias("_copies"), (F.count("*") > 1).alias("_tied"))
    copies = materialise(copies.filter("_copies > 0").select(*key, F.struct("_copies", "_tied").alias("_mix")), "copies")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.size(words_of(text_of())).cast("long").alias("_n"), row_key(docs).alias("_k"))
    same = F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size")) & (F.col("_k") == F.col("_key"))
    kept = rows.join(copies, same)
    once = kept.filter(~F.col("_mix._tied")).unionByName(kept.filter("_mix._tied").dropDuplicates(key))
    return once.select("_row", F.explode(F.sequence(F.lit(1), F.col("_mix._copies"))).alias("_k")).select("_row.*")
