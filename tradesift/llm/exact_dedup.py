"""Exact dedup by an extendible-hash index on shared files.

Keys are 64-bit hashes of the normalised text. The directory starts with one bucket and doubles until no bucket holds
more than ``bucket_keys`` distinct keys or the depth limit is met; a bucket is a key prefix of its local depth. Documents
reach their bucket through their slot of the directory. Texts are grouped by (bucket, key, text), so equality is decided
on bytes, and one group's copies collapse inside each map task before anything moves. Owner tasks take ranges of buckets,
number the texts that share a key (the chain) and write the index file of their range.

A document then looks its text up by bucket and key. Where the chain has one text, that is the document's own: the
grouping put every text of that key into one group by its bytes. Longer chains (collisions of the hash) hold the texts
themselves, and a document takes the link whose bytes equal its own.

Hot texts: those with more than a HOT_SHARE-th of all rows are fewer than HOT_SHARE and are looked up in a broadcast; what
is left has no key that could fill a task.

Defined cases: null text equals empty text; of rows that tie on the largest doc_id ``exact_groups`` marks each as kept,
and ``drop_copies`` returns one of them; a group whose ids are all null keeps a null id; an empty table gives an empty
result. Only doc_id and text are read by ``exact_groups``; ``drop_copies`` returns all columns of its input and no
others, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradesift.llm.common import ascii_lower, materialise, text_of

#: At most 2**DEPTH directory slots exist: this bounds what is broadcast.
DEPTH = 16
#: Keys that one owner holds in a bucket; beyond 2**DEPTH times as many texts buckets grow instead.
BUCKET_KEYS = 50_000
HOT_SHARE = 2_000


def hashed(norm: Column) -> Column:
    return F.xxhash64(norm)


class Lookup(NamedTuple):
    """``keys``: doc_id, bucket, key of every document. ``index``: the links of all chains, text only where a chain has
    several. ``collided``: bucket and key of those chains, or None if there is none."""

    keys: DataFrame
    index: DataFrame
    collided: DataFrame | None
    slots: DataFrame
    hash_of: Callable[[Column], Column]
    depth: int


def slot_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, bucket_keys: int = BUCKET_KEYS, depth: int = DEPTH) -> DataFrame:
    """slot, local_depth, bucket: for each finest prefix in use, the shallowest prefix that is not overfull."""
    fine = keys.select("key").distinct().groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count("*").alias("n"))
    levels = fine.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"))
    prefix = F.expr(f"shiftright(slot, {depth} - d)")
    # At most 2**(depth + 1) prefixes.
    full = levels.groupBy("d", prefix.alias("prefix")).agg(F.sum("n").alias("held"))
    fits = levels.withColumn("prefix", prefix).join(F.broadcast(full), ["d", "prefix"]).filter((F.col("held") <= bucket_keys) | (F.col("d") == depth))
    local = fits.groupBy("slot").agg(F.min("d").alias("local_depth"))
    return local.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {depth} - local_depth), {depth} - local_depth)"))


def placed(docs: DataFrame, found: Lookup, *more: Column) -> DataFrame:
    """Documents with their normalised text, at their bucket: key to slot to bucket."""
    keyed = docs.select(*more, ascii_lower(text_of()).alias("_norm")).withColumn("_key", found.hash_of(F.col("_norm")))
    slots = F.broadcast(found.slots.select(F.col("slot").alias("_slot"), F.col("bucket").alias("_bucket")))
    return keyed.withColumn("_slot", slot_of(F.col("_key"), found.depth)).join(slots, "_slot").drop("_slot")


def build(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, depth: int = DEPTH, hash_of: Callable[[Column], Column] = hashed) -> Lookup:
    """The index of ``docs``: bucket, key, chain, links, text, text_sha256, keep_id, group_size, in files by bucket."""
    bare = materialise(docs.select("doc_id", hash_of(ascii_lower(text_of())).alias("key")), "keys")
    slots = materialise(directory(bare, bucket_keys, depth), "directory")
    keys = bare.withColumn("slot", slot_of(F.col("key"), depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot").select("doc_id", "bucket", "key")
    found = Lookup(keys, bare, None, slots, hash_of, depth)
    texts = placed(docs, found, F.col("doc_id").alias("_id")).groupBy("_bucket", "_key", "_norm").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    texts = texts.select(F.col("_bucket").alias("bucket"), F.col("_key").alias("key"), F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size")
    links = F.count("*").over(Window.partitionBy("bucket", "key"))
    single = materialise(texts.repartitionByRange("bucket", "key").withColumn("links", links).sortWithinPartitions("bucket", "key"), "hash-index")
    single = single.withColumn("chain", F.lit(1)).withColumn("text", F.lit(None).cast("string"))
    collided = single.filter("links > 1").select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key")).distinct()
    if collided.isEmpty():
        return found._replace(index=single)
    collided = materialise(collided, "collided")
    chains = placed(docs, found, F.col("doc_id").alias("_id")).join(collided, ["_bucket", "_key"], "left_semi")
    chains = chains.groupBy("_bucket", "_key", "_norm").agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
    of_key = Window.partitionBy("bucket", "key")
    chains = chains.select(F.col("_bucket").alias("bucket"), F.col("_key").alias("key"), F.sha2("_norm", 256).alias("text_sha256"), "keep_id", "group_size", F.col("_norm").alias("text"))
    chains = chains.withColumn("links", F.count("*").over(of_key)).withColumn("chain", F.row_number().over(of_key.orderBy("text")))
    chained = materialise(chains.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"), "chains")
    return found._replace(index=single.filter("links = 1").unionByName(chained), collided=collided)


def exact_groups(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, depth: int = DEPTH, hash_of: Callable[[Column], Column] = hashed) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    found = build(docs, bucket_keys, depth, hash_of)
    facts = ["keep_id", "group_size", "text_sha256"]
    alone = found.index.filter("links = 1").select("bucket", "key", *facts)
    hot = alone.filter(F.col("group_size") * HOT_SHARE > found.keys.count())
    # At most HOT_SHARE rows.
    cold_keys = found.keys.join(F.broadcast(hot.select("bucket", "key")), ["bucket", "key"], "left_anti")
    rows = found.keys.join(F.broadcast(hot), ["bucket", "key"]).unionByName(cold_keys.join(alone, ["bucket", "key"])).select("doc_id", *facts)
    if found.collided is not None:
        chains = found.index.filter("links > 1").select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), F.col("text").alias("_norm"), *facts)
        unsure = placed(docs, found, F.col("doc_id")).join(found.collided, ["_bucket", "_key"], "left_semi")
        rows = rows.unionByName(unsure.join(chains, ["_bucket", "_key", "_norm"]).select("doc_id", *facts))
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, bucket_keys: int = BUCKET_KEYS, depth: int = DEPTH, hash_of: Callable[[Column], Column] = hashed) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each group of equal texts."""
    found = build(docs, bucket_keys, depth, hash_of)
    # Ids that several rows of one key have: only there may more than one row look like the one that stays.
    tied = found.keys.groupBy(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), F.col("doc_id").alias("_keep")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_bucket", "_key", "_keep", F.lit(True).alias("_ties"))
    winners = found.index.select(F.col("bucket").alias("_bucket"), F.col("key").alias("_key"), "links", F.col("text").alias("_text"), F.col("keep_id").alias("_keep"))
    same = ["_bucket", "_key"]
    marked = winners.alias("w").join(tied.alias("t"), (F.col("w._bucket") == F.col("t._bucket")) & (F.col("w._key") == F.col("t._key")) & F.col("w._keep").eqNullSafe(F.col("t._keep")), "left")
    marked = marked.select(F.col("w._bucket").alias("_b"), F.col("w._key").alias("_k"), F.struct("w.links", "w._text", F.coalesce("t._ties", F.lit(False)).alias("tied")).alias("_link"), F.col("w._keep").alias("_keep"))
    marked = materialise(marked, "kept")
    rows = placed(docs, found, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    wins = (F.col("_bucket") == F.col("_b")) & (F.col("_key") == F.col("_k")) & F.col("_id").eqNullSafe(F.col("_keep"))
    stay = rows.join(marked, wins).filter((F.col("_link.links") == 1) | (F.col("_link._text") == F.col("_norm")))
    once = stay.filter(~F.col("_link.tied")).unionByName(stay.filter("_link.tied").dropDuplicates([*same, "_norm"]))
    return once.select("_row.*")
