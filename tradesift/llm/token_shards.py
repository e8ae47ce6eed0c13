"""Token-ID output in training order: a keyed permutation gives every sequence its slot, shards hold slots by range.

Each text's ids, with the end-of-text id last, are cut into sequences of LENGTH ids; a text's last sequence is padded with
the end-of-text id. Sequences are numbered 0 to N - 1 by input split, row and place. A Feistel network keyed by ``key``
permutes the numbers; results of N or more are sent through again (cycle-walking), so the slots are a permutation of 0 to
N - 1. Task k receives the slots of shard k and writes them in order, each in a record of one fixed stride, so a reader
finds slot s at byte (s mod shard) * stride of file s div shard, and can resume anywhere.

Ids are made twice: once to count the sequences of each input split (one number per split goes to the driver), once to
write them. Storing them between would hold the corpus on disk once more. The second pass checks its counts against the
first, so an input whose splits differ between two reads fails instead of giving wrong slots; write such inputs to a
table first. Files are written under another name and renamed, so tasks may be repeated.

Defined cases: null and empty texts give one sequence, the end-of-text id alone; repeated rows give their own sequences;
an empty table writes no shard and returns no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradesift.llm.bpe import CHARS, read_ranks
from tradesift.llm.common import materialise, scratch_path, text_of

LENGTH, SHARD, KEY, ROUNDS = 256, 16_384, 0x5EED, 6


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of ``numbers`` under a keyed permutation of 0 to n - 1."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.uint64(key) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> shift, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (mixed(right + k) & mask)
        out[walking] = (left << shift) | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


_held: tuple = (None, None, None)


def tokenizer(tokens: list[bytes], pattern: str):
    """The encoder of a vocabulary; a worker process keeps the last one for its next tasks."""
    global _held
    if _held[0] is not tokens or _held[1] != pattern:
        import tiktoken

        _held = (tokens, pattern, tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={"<|end|>": len(tokens)}))
    return _held[2]


def ids_of(encoder, text: str) -> np.ndarray:
    """A text's ids, handed over as one buffer. No special token is ever read from a text."""
    return encoder.encode_to_numpy(text, disallowed_special=())


def slices(column: pa.Array, size: int = CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a column in turns of about ``size`` bytes, so that few texts are Python strings at a time."""
    turn = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)) // size
    borders = [0, *(np.flatnonzero(np.diff(turn)) + 1).tolist(), len(column)]
    for a, b in zip(borders, borders[1:]):
        if a < b:
            yield a, column.slice(a, b - a).to_pylist()


def write_shards(docs: DataFrame, path: str, pattern: str, out: str | None = None, length: int = LENGTH, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """slot, doc_id, seq, n_tokens, shard, offset of every sequence; the shards and manifest.json lie in ``out`` (a new
    folder in the shared one if None)."""
    spark = docs.sparkSession
    given = spark.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = out or scratch_path(spark, "shards")
    end = len(given.value)
    wide = np.dtype("<u2" if end < 1 << 16 else "<u4")
    stride = length * wide.itemsize

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = tokenizer(given.value, pattern)
        n = sum(len(ids_of(ids, t)) // length + 1 for b in batches for _, texts in slices(b.column(0)) for t in texts)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], ["split", "n"])

    counts = {r["split"]: r["n"] for r in docs.select(text_of().alias("text")).mapInArrow(count, "split long, n long").collect()}
    total = sum(counts.values())
    starts, at = {}, 0
    for split in sorted(counts):
        starts[split] = (at, counts[split])
        at += counts[split]
    starts = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids = tokenizer(given.value, pattern)
        number, expected = starts.value.get(TaskContext.get().partitionId(), (0, 0))
        last = number + expected
        for batch in batches:
            for a, texts in slices(batch.column(1)):
                coded = []
                for t in texts:
                    found = ids_of(ids, t)
                    own = np.empty(len(found) + 1, wide)
                    own[:-1], own[-1] = found, end
                    coded.append(own)
                sizes = np.array([-(-len(x) // length) for x in coded])
                rows = np.repeat(np.arange(len(coded)), sizes)
                seq = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # Sequences lie one after the other, so one buffer with their borders is the whole column.
                held = np.minimum(length, np.array([len(x) for x in coded])[rows] - seq * length)
                borders = np.concatenate(([0], np.cumsum(held * wide.itemsize))).astype(np.int32)
                slots = permuted(number + np.arange(len(rows)), total, key)
                number += len(rows)
                if number > last:
                    raise RuntimeError("an input split holds other rows than when it was counted")
                payload = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(borders), pa.py_buffer(b"".join(coded))])
                yield pa.RecordBatch.from_arrays([pa.array(slots), batch.column(0).take(pa.array(a + rows)), pa.array(seq, pa.int64()), payload], ["slot", "doc_id", "seq", "ids"])
        if number != last:
            raise RuntimeError("an input split holds other rows than when it was counted")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store = name = file = None
        expected = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            slots = batch.column(0).to_numpy()
            if file is None:
                store, folder = pa_fs(out)
                store.create_dir(folder, recursive=True)
                expected = int(slots[0])
                name = f"{folder}/shard-{expected // shard:06d}"
                temp = f"{name}.{TaskContext.get().taskAttemptId()}.part"
                file = store.open_output_stream(temp)
            if not np.array_equal(slots, np.arange(expected, expected + len(slots))):
                raise RuntimeError(f"slots of {name} are not in sequence")
            expected += len(slots)
            ids = batch.column(3)
            borders = np.frombuffer(ids.buffers()[1], np.int64 if pa.types.is_large_binary(ids.type) else np.int32)[ids.offset : ids.offset + len(ids) + 1]
            n = np.diff(borders) // wide.itemsize
            records = np.full((len(ids), length), end, wide)
            records[np.arange(length) < n[:, None]] = np.frombuffer(ids.buffers()[2], np.uint8)[borders[0] : borders[-1]].view(wide)
            file.write(records.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(n.astype(np.int32)), pa.array(slots // shard), pa.array(slots % shard * stride)], ["slot", "doc_id", "seq", "n_tokens", "shard", "offset"])
        if file is not None:
            file.close()
            store.move(temp, name)

    sequences = docs.select("doc_id", text_of().alias("text")).mapInArrow(cut, f"slot long, doc_id {kind}, seq long, ids binary")
    ranged = sequences.repartitionById(max(1, -(-total // shard)), F.expr(f"cast(slot div {shard} as int)")).sortWithinPartitions("slot")
    written = materialise(ranged.mapInArrow(write, f"slot long, doc_id {kind}, seq long, n_tokens int, shard long, offset long"), "slots")
    store, folder = pa_fs(out)
    store.create_dir(folder, recursive=True)
    with store.open_output_stream(f"{folder}/manifest.json") as f:
        f.write(json.dumps({"sequences": total, "length": length, "stride": stride, "shard": shard, "dtype": wide.str, "end": end, "key": key}).encode())
    return written


def pa_fs(uri: str):
    """A file system and a path in it, for paths with or without a scheme."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def read_sequences(out: str, slot: int, count: int) -> np.ndarray:
    """``count`` sequences from ``slot`` on, in training order; sequential reads of whole shards' parts."""
    store, folder = pa_fs(out)
    with store.open_input_stream(f"{folder}/manifest.json") as f:
        m = json.loads(f.read())
    count = max(0, min(count, m["sequences"] - slot))
    parts = []
    while count:
        first = slot % m["shard"]
        n = min(count, m["shard"] - first)
        with store.open_input_file(f"{folder}/shard-{slot // m['shard']:06d}") as f:
            f.seek(first * m["stride"])
            parts.append(np.frombuffer(f.read(n * m["stride"]), m["dtype"]).reshape(n, m["length"]))
        slot, count = slot + n, count - n
    return np.concatenate(parts) if parts else np.zeros((0, m["length"]), m["dtype"])
