"""SimHash near-dedup by anchor points of a covering code.

Fingerprints within THRESHOLD = 3 bits agree up to one bit in the low or the high half (3 = 1 + 1 + 1: two halves cannot
both differ in two). In each half the anchors are the codewords of the perfect [31, 26] Hamming code on the half's low
31 bits: covering radius 1, so every fingerprint has one home anchor. A fingerprint is replicated to every anchor within
radius + 1 of its half: its home, and 15 more when it is no codeword itself (a codeword's neighbours are all at home
with it). Two fingerprints whose halves differ in at most one bit therefore meet at the home anchor of either.

Work is on distinct fingerprints. Records are shuffled by anchor and sorted, and a vectorised pass compares the homes of
an anchor with its visitors, in blocks; it emits a spanning forest of the links it finds, never all pairs. Anchors with
more than HOT homes are dealt again by the four bytes of the other half: at most 3 bits differ there, so one byte is
equal. Components are found by alternating large-star and small-star steps on tables in the shared folder.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are linked like any other;
repeated rows and ties share a component; a null doc_id never names a component unless all of its rows are null; an
empty table gives an empty result. Only doc_id and text are read by ``near_groups``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradesift.llm.common import materialise, text_of

THRESHOLD = 3
SHINGLE = 3
SEED = 42
HOT = 2_000
BLOCK = 1 << 21
#: Anchors with so few records are compared together, many at a time.
FEW = 16
#: Shingles hashed at a time; bounds the memory that one very long text takes.
SHINGLE_BLOCK = 1 << 16


def fingerprint(text: str) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - SHINGLE + 1
    total = np.zeros(64, np.int64)
    digest, seed = xxhash.xxh64_intdigest, SEED
    for k in range(0, n, SHINGLE_BLOCK):
        m = min(n, k + SHINGLE_BLOCK)
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts[k:m].tolist(), ends[k + SHINGLE - 1 : m + SHINGLE - 1].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * total > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash that tells rows of one doc_id apart), fp (the 64 bits as a signed long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text_of()), text_of().alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, text_key long, fp long")


def syndrome(x: np.ndarray) -> np.ndarray:
    """Of 31-bit words: the XOR of the places (1 to 31) of the bits that are set. Codewords have syndrome 0."""
    s = np.zeros(x.shape, np.uint32)
    for bit, mask in enumerate(sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1) for k in range(5)):
        y = x & np.uint32(mask)
        for step in (16, 8, 4, 2, 1):
            y = y ^ (y >> np.uint32(step))
        s |= (y & np.uint32(1)) << np.uint32(bit)
    return s


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) of every anchor that a half's low 31 bits are replicated to."""
    x = half & np.uint32(0x7FFFFFFF)
    s = syndrome(x)
    one = np.uint32(1)
    flip = lambda places: np.where(places > 0, one << ((places - one) & np.uint32(31)), np.uint32(0)).astype(np.uint32)
    rows, found, home = [np.arange(len(x))], [x ^ flip(s)], [np.ones(len(x), bool)]
    off = np.flatnonzero(s)
    for p in range(1, 32):
        # Flipping places p and q with p ^ q = s gives a codeword at distance two; each pair is taken once.
        q = s[off] ^ np.uint32(p)
        use = off[(q > p)]
        rows.append(use)
        found.append(x[use] ^ (one << np.uint32(p - 1)) ^ flip(s[use] ^ np.uint32(p)))
        home.append(np.zeros(len(use), bool))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for k in range(0, len(all_fps), 20_000):
            fps = all_fps[k : k + 20_000]
            for side in (0, 1):
                rows, anchor, home = anchors((fps >> np.uint64(32 * side)).astype(np.uint32))
                key = (anchor.astype(np.int64) << 1) | side
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(fps[rows].view(np.int64))], ["anchor", "home", "fp"])


def spanning(left: np.ndarray, right: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between places of ``values``: each place linked to the least value of its component, as (a, b) pairs."""
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            break
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[label[moved]], values[moved]


def links_at(fps: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the homes of one anchor and everything replicated to it."""
    values, at = np.unique(fps, return_inverse=True)
    home = np.unique(at[homes])
    if not len(home) or len(values) < 2:
        return values[:0], values[:0]
    left, right, step = [], [], max(1, BLOCK // len(values))
    held = 0
    for k in range(0, len(home), step):
        block = home[k : k + step]
        near = np.bitwise_count(values[block][:, None] ^ values[None, :]) <= THRESHOLD
        i, j = np.nonzero(near)
        i = block[i]
        use = i != j
        left.append(i[use])
        right.append(j[use])
        held += int(use.sum())
        if held > BLOCK:  # fold what is held into a forest
            a, b = spanning(np.concatenate(left), np.concatenate(right), np.arange(len(values)))
            left, right, held = [a], [b], len(a)
    return spanning(np.concatenate(left), np.concatenate(right), values)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records sorted by (anchor, part); a group may run over any number of batches."""
    from collections import deque

    def solve(keys: np.ndarray, homes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        edges = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
        starts = np.concatenate(([0], edges))
        sizes = np.diff(np.concatenate((starts, [len(fps)])))
        out_a, out_b = [], []
        # Groups of 2 to FEW records are compared together: every record with the k-th next one of its group.
        small = np.repeat(sizes <= FEW, sizes)
        group = np.repeat(np.arange(len(sizes)), sizes)
        for k in range(1, min(FEW, int(sizes.max()))):
            pair = np.flatnonzero((group[k:] == group[:-k]) & small[k:])
            if not len(pair):
                break
            near = (homes[pair] | homes[pair + k]) & (np.bitwise_count(fps[pair] ^ fps[pair + k]) <= THRESHOLD) & (fps[pair] != fps[pair + k])
            out_a.append(fps[pair[near]])
            out_b.append(fps[pair[near] + k])
        for g in np.flatnonzero(sizes > FEW):
            a, b = links_at(fps[starts[g] : starts[g] + sizes[g]], homes[starts[g] : starts[g] + sizes[g]])
            out_a.append(a)
            out_b.append(b)
        if not out_a:
            return None
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if not len(a):
            return None
        pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].view(np.int64)), pa.array(pairs[:, 1].view(np.int64))], ["a", "b"])

    held: deque[tuple[np.ndarray, np.ndarray, np.ndarray]] = deque()
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack((batch.column(0).to_numpy(), batch.column(1).to_numpy()), axis=1)
        homes = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        fps = batch.column(3).to_numpy().view(np.uint64)
        # All but the last group of this batch is complete.
        change = np.flatnonzero(np.any(keys != keys[-1], axis=1))
        if len(change):
            cut = change[-1] + 1
            held.append((keys[:cut], homes[:cut], fps[:cut]))
            found = solve(*[np.concatenate(x) for x in zip(*held)])
            held.clear()
            if found is not None:
                yield found
            keys, homes, fps = keys[cut:], homes[cut:], fps[cut:]
        held.append((keys, homes, fps))
    if held:
        found = solve(*[np.concatenate(x) for x in zip(*held)])
        if found is not None:
            yield found


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links between distinct fingerprints whose closure is that of all links. ``prints``: fp, distinct."""
    spread = prints.select("fp").mapInArrow(_replicas, "anchor long, home boolean, fp long")
    # Homes alone tell which anchors are hot; two for each fingerprint.
    crowded = spread.filter("home").groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("anchor", F.lit(True).alias("crowded"))
    other = F.when(F.col("anchor").bitwiseAND(1) == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    byte = lambda k: (F.lit((k + 1) << 8) + F.shiftrightunsigned(other, 8 * k).bitwiseAND(255)).cast("long")
    parts = F.when(F.col("crowded"), F.array(*[byte(k) for k in range(4)])).otherwise(F.array(F.lit(0).cast("long")))
    dealt = spread.join(crowded, "anchor", "left").select("anchor", F.explode(parts).alias("part"), "home", "fp")
    return dealt.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_links, "a long, b long")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node it is linked to, as a signed long): alternating stars until nothing changes."""
    edges, before = materialise(edges.distinct(), "edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Large star: every larger neighbour moves to the least node of the neighbourhood.
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a != b").distinct()
        # Small star: a node and its smaller neighbours move to the least of them.
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        edges = materialise(small, "edges")
        h = F.xxhash64("a", "b")
        after = edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 40)))).first()
        if after == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def grouped(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, text_key, fp, root, component_id: one row per row of ``docs``."""
    marked = materialise(fingerprints(docs), "fingerprints")
    prints = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints, hot))
    rooted = materialise(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "root", "component_id"), "fp")


def near_groups(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of ``docs``."""
    return grouped(docs, hot).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each component one row, of those with its smallest doc_id
    (of several texts under that id, one; of equal rows, one)."""
    names = docs.columns
    first = grouped(docs, hot).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    keep = first.groupBy("root").agg(F.min(F.struct("doc_id", "text_key", "n")).alias("k"))
    keep = materialise(keep.select(F.col("k.doc_id").alias("_id"), F.col("k.text_key").alias("_key"), F.struct((F.col("k.n") > 1).alias("tied")).alias("_keep")), "near-kept")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64(text_of()).alias("_t"))
    stay = rows.join(keep, F.col("_d").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_key")))
    once = stay.filter(~F.col("_keep.tied")).unionByName(stay.filter("_keep.tied").dropDuplicates(["_id", "_key"]))
    return once.select("_row.*")
