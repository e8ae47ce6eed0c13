"""Removal of repeated passages by a hash-compared suffix sort.

A byte goes if a string of ``width`` bytes covers it that also starts earlier: in a row of smaller doc_id, or in the same
text before. Matches never cross texts; strings are judged on the input.

Only suffixes that can matter are sorted. Each string of ``width`` bytes has one anchor: its ``gram`` bytes of least hash,
the first of equals. Equal strings have equal anchors at the same offset, so strings meet at their anchors. The strings of
one anchor in a text start side by side; the bytes that they cover are a segment. All hashes are differences of prefix
polynomial hashes, so any stretch of a text has its hash in one step.

1. Texts are stored once, bucketed by block (up to 4,096 rows of one input split); later steps read the buckets in place.
2. Each batch of some RECORDS segments sends one record for each different anchor that it holds: the anchor's and the
   segment's hash and where it comes first, or how many different segments it stands in. So an anchor that a third of all
   texts hold has a record a batch, not a text. Owners of anchor ranges tell the blocks which anchors recur, and whether in one segment or several.
3. Segments that recur as a whole are repeats but for the first. The others, with their text, go to the anchor's owner.
   It sorts the suffixes from the anchors on, and the reversed prefixes before them, by mergesort: a comparison finds the
   common extension by binary search over hashes, and reads the byte after it. Strings at one offset are equal if both
   neighbours' extensions reach far enough all the way between them in either order; the first one stays. Every pair of
   neighbours is then compared byte by byte; if a hash has collided, the sort is done again with another base.
4. An anchor that stands in more than ``HOT`` different segments is not gathered: its strings are dealt by two hashes of
   their own, one record for each that a block holds, and each such owner finds the first.
5. Blocks cut out what was found.

Segments that recur as a whole are told by two 64-bit hashes of different bases and their length, 128 bits in all, and
likewise the strings of step 4; their bytes stand in different blocks and are not compared.

Defined cases: null text counts as empty; texts shorter than ``width`` keep everything; rows that share a doc_id count in
the order they are stored in, and rows with a null doc_id come last; an empty table gives an empty result. Only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradesift.llm.common import materialise, scratch_path, text_of, unique

WIDTH, GRAM = 100, 32
HOT = 5_000
BLOCK_ROWS = 1 << 12
#: Bytes of text whose anchors one owner looks after, about; bytes that are hashed, and records that are sorted, at a time.
OWNED, CHUNK, RECORDS = 1 << 23, 1 << 18, 1 << 18
#: Odd, so each has an inverse modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
MIX = np.uint64(0xFF51AFD7ED558CCD)
PLACE = np.uint64((1 << 31) - 1)
LAST = (1 << 63) - 1
ONE, SEVERAL, MANY = 1, 2, 3

ANCHORS = {"anchor": "u8", "segment": "u8", "doc": "i8", "row": "u4", "start": "u4", "n": "u4"}
VERDICTS = {"anchor": "u8", "kind": "u1", "doc": "i8", "block": "i8", "row": "u4", "start": "u4"}
SEGMENTS = {"anchor": "u8", "doc": "i8", "row": "u4", "start": "u4", "offset": "u2", "strings": "u2", "size": "u4"}
STRINGS = {"one": "u8", "two": "u8", "doc": "i8", "row": "u4", "start": "u4"}
SPANS = {"row": "u4", "start": "u4", "end": "u4"}
Rows = dict[str, np.ndarray]


def pack(rows: Rows, kinds: dict[str, str]) -> bytes:
    """Columns one after another, the bytes of a column by their place in its numbers: small numbers compress well so."""
    return b"".join(np.ascontiguousarray(rows[c], k).view(np.uint8).reshape(len(rows[c]), int(k[1:])).T.tobytes() for c, k in kinds.items())


def unpack(blobs: list[bytes], kinds: dict[str, str]) -> Rows:
    width, parts = sum(int(k[1:]) for k in kinds.values()), []
    for blob in blobs:
        n, at, one = len(blob) // width, 0, {}
        for c, k in kinds.items():
            size = int(k[1:])
            one[c] = np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T.copy().view(k).reshape(n)
            at += n * size
        parts.append(one)
    return {c: np.concatenate([np.zeros(0, k), *(p[c] for p in parts)]) for c, k in kinds.items()}


def picked(rows: Rows, which: np.ndarray) -> Rows:
    return {c: v[which] for c, v in rows.items()}


def joined(parts: list[Rows], kinds: dict[str, str]) -> Rows:
    return {c: np.concatenate([np.zeros(0, k), *(p[c] for p in parts)]) for c, k in kinds.items()}


def changes(*columns: np.ndarray) -> np.ndarray:
    """Of rows in order: whether a row differs from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Powers:
    """Powers of a base modulo 2 ** 64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            grown = [np.full(max(n + 1, CHUNK), b, np.uint64) for b in (self.base, self.inverse)]
            for g in grown:
                g[0] = 1
            self.up, self.down = (np.cumprod(g, dtype=np.uint64) for g in grown)


class Hashes:
    """Prefix polynomial hashes of some bytes."""

    def __init__(self, data: np.ndarray, powers: Powers):
        powers.reach(len(data))
        self.down = powers.down
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * powers.up[: len(data)], dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]

    def all_of(self, size: int) -> np.ndarray:
        """Of every stretch of ``size`` bytes."""
        n = len(self.prefix) - size
        return (self.prefix[size:] - self.prefix[:n]) * self.down[:n]


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by running minima of blocks from either side."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(ahead[: n - width + 1], np.minimum.accumulate(blocks, axis=1).reshape(-1)[width - 1 : n])


class Segmenter:
    def __init__(self, width: int = WIDTH, gram: int = GRAM):
        self.width, self.gram = width, gram
        self.powers = [Powers(b) for b in BASES[:2]]

    def __call__(self, data: np.ndarray, sizes: np.ndarray) -> tuple[Rows, list[Hashes]]:
        """The segments of texts that stand one after another in ``data``: text, start and anchor's place (both in
        ``data``), number of strings, hashes of the anchor and of the segment. With them the hashes of ``data``."""
        hashes = [Hashes(data, p) for p in self.powers]
        if len(data) < self.width:
            none = np.zeros(0, np.int64)
            return {"text": none, "start": none, "at": none, "strings": none, "anchor": none.astype(np.uint64), "segment": none.astype(np.uint64)}, hashes
        grams = hashes[0].all_of(self.gram)
        order = grams ^ (grams >> np.uint64(29))
        order *= MIX
        order &= ~PLACE
        order |= np.arange(len(order), dtype=np.uint64)
        anchor = (least_of(order, self.width - self.gram + 1) & PLACE).astype(np.int64)
        text = np.repeat(np.arange(len(sizes)), sizes)
        inside = np.flatnonzero(text[: len(data) - self.width + 1] == text[self.width - 1 :])
        anchor = anchor[inside]
        first = np.flatnonzero(changes(anchor, text[inside]))
        strings = np.diff(np.append(first, len(inside)))
        start, at = inside[first], anchor[first]
        return {"text": text[start], "start": start, "at": at, "strings": strings, "anchor": grams[at], "segment": hashes[1].of(start, start + strings + self.width - 1)}, hashes


def chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and sizes of ranges of texts of about CHUNK bytes, one text at least."""
    if isinstance(texts, pa.ChunkedArray):
        first = 0
        for part in texts.chunks:
            yield from ((first + a, data, sizes) for a, data, sizes in chunks(part))
            first += len(part)
        return
    wide = texts.type == pa.large_binary()
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])
        a = b


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of longs, nulls as the largest."""
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else np.concatenate([np.zeros(0, np.int64), *map(numbers, column.chunks)])


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of ``data`` one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


def dealt(rows: Rows, kinds: dict[str, str], key: str, owners: int, block: int, kind: str) -> Iterator[tuple]:
    """Records of a block as one row for each owner of their keys."""
    owner = (rows[key] >> np.uint64(11)) % np.uint64(owners)
    order = np.argsort(owner, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else []:
        yield kind, int(owner[own[0]]), block, pack(picked(rows, own), kinds), own


def batch_of(rows: list[tuple], names: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names.split())


def to_blocks(block: np.ndarray, rows: Rows, kinds: dict[str, str]) -> pa.Table:
    """Records as one row for each block that they are meant for."""
    order = np.argsort(block, kind="stable")
    cut = np.flatnonzero(np.diff(block[order])) + 1
    out = [(int(block[own[0]]), pack(picked(rows, own), kinds)) for own in np.split(order, cut)] if len(order) else []
    return pa.Table.from_batches([batch_of(out, "block rows", [pa.int64(), pa.binary()])])


def first_of_batch(found: list[Rows]) -> Rows:
    """One ANCHORS record for each anchor; n: different segments, 0 if it stands once."""
    rows = joined(found, ANCHORS)
    rows = picked(rows, np.lexsort((rows["start"], rows["row"], rows["doc"], rows["segment"], rows["anchor"])))
    new = changes(rows["anchor"])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(new)))
    different = np.add.reduceat(changes(rows["anchor"], rows["segment"]).astype(np.int64), first) if len(first) else first
    return picked(rows, first) | {"n": np.where(count == 1, 0, different).astype(np.uint32)}


def recurring(blobs: list[tuple[int, bytes]]) -> pa.Table:
    """Verdicts on the anchors of one owner that recur, for the blocks that hold them."""
    parts = [unpack([b], ANCHORS) for _, b in blobs]
    rows = joined(parts, ANCHORS)
    block = np.repeat(np.array([b for b, _ in blobs], np.int64), [len(p["n"]) for p in parts])
    order = np.lexsort((rows["start"], rows["row"], block, rows["doc"], rows["segment"], rows["anchor"]))
    rows, block = picked(rows, order), block[order]
    first = np.flatnonzero(changes(rows["anchor"]))
    size = np.diff(np.append(first, len(block)))
    most = np.maximum.reduceat(rows["n"], first)
    segments = np.add.reduceat(changes(rows["anchor"], rows["segment"]).astype(np.int64), first)
    total = np.add.reduceat(np.maximum(rows["n"], 1).astype(np.int64), first)
    kind = np.where((most > 1) | (segments > 1), np.where(total > HOT, MANY, SEVERAL), ONE)
    spread = lambda v: np.repeat(v, size)
    again = spread((size > 1) | (most > 0))
    head = spread(first)
    out = {"anchor": rows["anchor"], "kind": spread(kind), "doc": rows["doc"][head], "block": block[head], "row": rows["row"][head], "start": rows["start"][head]}
    return to_blocks(block[again], picked(out, again), VERDICTS)


def extension(one: Hashes, p: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many bytes from ``p`` and from ``q`` on agree, up to ``most``: by binary search over hashes."""
    low, high = np.zeros(len(p), np.int64), most.copy()
    while len(left := np.flatnonzero(low < high)):
        half = (low[left] + high[left] + 1) >> 1
        same = one.of(p[left], p[left] + half) == one.of(q[left], q[left] + half)
        low[left[same]] = half[same]
        high[left[~same]] = half[~same] - 1
    return low


def sorted_suffixes(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes from ``at`` on, ``size`` bytes long, inside each group (groups stand in order), and what each
    has in common with the one before (0 at a group's first).

    Mergesort of all groups at once: in each round a row finds its place in the neighbouring run by binary search."""
    for base in BASES[2:]:
        hashes = Hashes(data, Powers(base))
        padded = np.append(data.astype(np.int64), -1)

        def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """-1, 0 or 1 as suffix a is below, equal to or above b."""
            most = np.minimum(size[a], size[b])
            n = extension(hashes, at[a], at[b], most)
            x = np.where(n < size[a], padded[np.minimum(at[a] + n, len(data))], -1)
            y = np.where(n < size[b], padded[np.minimum(at[b] + n, len(data))], -1)
            return np.sign(x - y)

        n = len(at)
        order = np.arange(n)
        head = np.flatnonzero(changes(group)) if n else order
        members = np.diff(np.append(head, n))
        base_of, many = np.repeat(head, members), np.repeat(members, members)
        place = np.arange(n) - base_of
        run = 1
        while len(live := np.flatnonzero(many > run)):
            mine = place[live] // run
            other = base_of[live] + (mine ^ 1) * run
            low = other.copy()
            high = np.minimum(other + run, base_of[live] + many[live])
            high = np.maximum(low, high)
            while len(open_ := np.flatnonzero(low < high)):
                half = (low[open_] + high[open_]) >> 1
                sign = below(order[half], order[live[open_]])
                # Of equals the left run's come first.
                up = (sign < 0) | ((sign == 0) & (mine[open_] % 2 == 1))
                low[open_[up]] = half[up] + 1
                high[open_[~up]] = half[~up]
            to = base_of[live] + (mine & ~1) * run + place[live] % run + (low - other)
            merged = order.copy()
            merged[to] = order[live]
            order, run = merged, run * 2
        common = np.zeros(n, np.int64)
        inner = np.flatnonzero(~changes(group)) if n else order
        a, b = order[inner - 1], order[inner]
        common[inner] = extension(hashes, at[a], at[b], np.minimum(size[a], size[b]))
        sure = True
        for k in range(0, len(inner), 1 << 15):
            x, y, c = a[k : k + (1 << 15)], b[k : k + (1 << 15)], common[inner[k : k + (1 << 15)]]
            agree = gathered(data, at[x], c) == gathered(data, at[y], c)
            ends = lambda r, c=c: np.where(c < size[r], padded[np.minimum(at[r] + c, len(data))], -1)
            sure = sure and bool(agree.all()) and bool(((ends(x) < ends(y)) | (c == size[x]) & (c == size[y])).all())
        if sure:
            return order, common
    raise RuntimeError("hashes collided with every base")


def repeated_strings(rows: Rows, block: np.ndarray, data: np.ndarray, width: int) -> pa.Table:
    """Spans of the strings in some segments that come earlier in others of the same anchor. ``data``: the segments' bytes,
    one after another."""
    n = len(block)
    offset, strings = rows["offset"].astype(np.int64), rows["strings"].astype(np.int64)
    size = rows["size"].astype(np.int64)
    start = np.cumsum(size) - size
    by_anchor = np.argsort(rows["anchor"], kind="stable")
    rows, block, offset, strings, size, start = picked(rows, by_anchor), block[by_anchor], offset[by_anchor], strings[by_anchor], size[by_anchor], start[by_anchor]
    at = start + offset
    right, right_common = sorted_suffixes(data, at, size - offset, rows["anchor"])
    left, left_common = sorted_suffixes(data[::-1].copy(), len(data) - at, offset, rows["anchor"])
    place = rows["start"].astype(np.int64) + offset  # of the anchor in its text
    ranked = np.lexsort((place, rows["row"], block, rows["doc"]))
    own = np.zeros((n, int(offset.max(initial=0)) + 3), bool)
    # One string of each segment at most has a given offset, the distance from its start to the anchor.
    for back in range(own.shape[1] - 2):
        has = ranked[(offset[ranked] >= back) & (offset[ranked] - strings[ranked] < back)]
        if len(has) < 2:
            continue
        after, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
        after[right] = np.cumsum(right_common < width - back)
        before[left] = np.cumsum(changes(rows["anchor"])) if back == 0 else np.cumsum(left_common < back)
        _, first = np.unique(after[has] * (n + 1) + before[has], return_index=True)
        again = np.ones(len(has), bool)
        again[first] = False
        own[has[again], back + 1] = True
    who, begin = np.nonzero(own[:, 1:] & ~own[:, :-1])
    _, end = np.nonzero(own[:, :-1] & ~own[:, 1:])  # one past the last of a stretch of offsets, in the same order
    spans = {"row": rows["row"][who], "start": (place[who] - (end - 1)).astype(np.uint32), "end": (place[who] - begin + width).astype(np.uint32)}
    return to_blocks(block[who], spans, SPANS)


def later_strings(blobs: list[tuple[int, bytes]], width: int) -> pa.Table:
    """Spans of the strings of one owner that another block holds earlier."""
    parts = [unpack([b], STRINGS) for _, b in blobs]
    rows = joined(parts, STRINGS)
    block = np.repeat(np.array([b for b, _ in blobs], np.int64), [len(p["one"]) for p in parts])
    order = np.lexsort((rows["start"], rows["row"], block, rows["doc"], rows["two"], rows["one"]))
    rows, block = picked(rows, order), block[order]
    again = ~changes(rows["one"], rows["two"])
    return to_blocks(block[again], {"row": rows["row"][again], "start": rows["start"][again], "end": rows["start"][again] + np.uint32(width)}, SPANS)


def merged_spans(rows: Rows) -> Rows:
    """Spans in order, those that touch or overlap as one."""
    rows = picked(rows, np.lexsort((rows["start"], rows["row"])))
    if not len(rows["row"]):
        return rows
    wide = (rows["row"].astype(np.int64) << 32) + rows["end"]
    reach = np.maximum.accumulate(wide)  # ends of earlier rows of the table lie below
    new = np.append(True, (rows["row"][1:].astype(np.int64) << 32) + rows["start"][1:] > reach[:-1])
    first = np.flatnonzero(new)
    return {"row": rows["row"][first], "start": rows["start"][first], "end": (np.maximum.reduceat(wide, first) & 0xFFFFFFFF).astype(np.uint32)}


def judged(block: int, table: pa.Table, known: Rows, width: int, gram: int, owners: int) -> Iterator[tuple]:
    """Of a block's texts: spans that are repeats for sure, segments to be sorted, strings to be dealt, as rows of
    (kind, owner, block, rows, bytes)."""
    known = picked(known, np.argsort(known["anchor"], kind="stable"))
    segmenter, doc, row = Segmenter(width, gram), numbers(table.column("doc")), numbers(table.column("row"))
    spans, found, bytes_of, strings = [], [], [], []
    for a, data, sizes in chunks(table.column("text")):
        s, hashes = segmenter(data, sizes)
        where = np.searchsorted(known["anchor"], s["anchor"])
        hit = np.zeros(len(where), bool)
        inside = where < len(known["anchor"])
        hit[inside] = known["anchor"][where[inside]] == s["anchor"][inside]
        s, where = picked(s, np.flatnonzero(hit)), where[hit]
        v = picked(known, where)
        begins = np.cumsum(sizes) - sizes
        own = {"doc": doc[a + s["text"]], "row": row[a + s["text"]].astype(np.uint32), "start": (s["start"] - begins[s["text"]]).astype(np.uint32)}
        is_first = (own["doc"] == v["doc"]) & (v["block"] == block) & (own["row"] == v["row"]) & (own["start"] == v["start"])
        again = (v["kind"] == ONE) & ~is_first
        spans.append({"row": own["row"][again], "start": own["start"][again], "end": (own["start"][again] + s["strings"][again] + width - 1).astype(np.uint32)})
        open_ = np.flatnonzero(v["kind"] != ONE)
        size = s["strings"][open_] + width - 1
        found.append(picked(own, open_) | {"anchor": s["anchor"][open_], "segment": s["segment"][open_], "kind": v["kind"][open_], "offset": (s["at"] - s["start"])[open_], "strings": s["strings"][open_], "size": size})
        bytes_of.append(gathered(data, s["start"][open_], size))
    kinds = SEGMENTS | {"segment": "u8", "kind": "u1"}
    rows, data = joined(found, kinds), np.concatenate([np.zeros(0, np.uint8), *bytes_of])
    rows["at"] = np.cumsum(rows["size"].astype(np.int64)) - rows["size"]
    rows = picked(rows, np.lexsort((rows["start"], rows["row"], rows["doc"], rows["segment"], rows["anchor"])))
    # Of equal segments of a block the first speaks for all.
    again = ~changes(rows["anchor"], rows["segment"]) if len(rows["row"]) else np.zeros(0, bool)
    spans.append({"row": rows["row"][again], "start": rows["start"][again], "end": rows["start"][again] + rows["size"][again]})
    rows = picked(rows, ~again)
    sorted_ = picked(rows, rows["kind"] == SEVERAL)
    for kind, owner, _, blob, own in dealt(sorted_, SEGMENTS, "anchor", owners, block, "segments"):
        yield kind, owner, block, blob, gathered(data, sorted_["at"][own], sorted_["size"].astype(np.int64)[own]).tobytes()
    many = picked(rows, rows["kind"] == MANY)
    for k in range(0, len(many["row"]), CHUNK // width):
        part = picked(many, slice(k, k + CHUNK // width))
        n = part["strings"].astype(np.int64)
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        text = gathered(data, part["at"], part["size"].astype(np.int64))
        begin = np.repeat(np.cumsum(part["size"].astype(np.int64)) - part["size"], n) + nth
        one, two = (Hashes(text, p).of(begin, begin + width) for p in segmenter.powers)
        strings.append({"one": one, "two": two, "doc": np.repeat(part["doc"], n), "row": np.repeat(part["row"], n), "start": (np.repeat(part["start"], n) + nth).astype(np.uint32)})
    dealt_ = joined(strings, STRINGS)
    dealt_ = picked(dealt_, np.lexsort((dealt_["start"], dealt_["row"], dealt_["doc"], dealt_["two"], dealt_["one"])))
    again = ~changes(dealt_["one"], dealt_["two"]) if len(dealt_["row"]) else np.zeros(0, bool)
    spans.append({"row": dealt_["row"][again], "start": dealt_["start"][again], "end": dealt_["start"][again] + np.uint32(width)})
    for kind, owner, _, blob, _ in dealt(picked(dealt_, ~again), STRINGS, "one", owners, block, "strings"):
        yield kind, owner, block, blob, b""
    yield "spans", 0, block, pack(merged_spans(joined(spans, SPANS)), SPANS), b""


MESSAGE = "kind string, owner long, block long, rows binary, bytes binary"
MESSAGE_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]


def _blobs(table: pa.Table) -> list[tuple[int, bytes]]:
    return list(zip(table.column("block").to_pylist(), table.column("rows").to_pylist()))


def _owned(messages: DataFrame, judge: Callable[[pa.Table], pa.Table]) -> DataFrame:
    return messages.groupBy("owner").applyInArrow(judge, "block long, rows binary")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (array of start, end: the removed bytes), kept (the other bytes): one row per row of ``docs``."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.select(F.col("doc_id"), text_of().cast("binary").alias("text"), F.monotonically_increasing_id().alias("place"))
    block, row = F.shiftright("place", 12), F.col("place").bitwiseAND(BLOCK_ROWS - 1)
    name = f"texts_{unique()}"
    rows = placed.select("doc_id", F.col("doc_id").cast("long").alias("doc"), "text", F.octet_length("text").alias("size"), block.alias("block"), row.alias("row"))
    rows.write.bucketBy(partitions, "block").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, in the folder that goes with the application
    owners = max(partitions, int(texts.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0) // OWNED)

    def sent(found: list[Rows], block: int) -> pa.RecordBatch:
        out = [(owner, of, blob) for _, owner, of, blob, _ in dealt(first_of_batch(found), ANCHORS, "anchor", owners, block, "anchors")]
        return batch_of(out, "owner block rows", [pa.int64(), pa.int64(), pa.binary()])

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(width, gram)
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            cut = np.flatnonzero(np.diff(blocks)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(blocks)]):
                part, found, held = batch.slice(a, b - a), [], 0
                doc, row = numbers(part.column("doc")), numbers(part.column("row"))
                for k, data, sizes in chunks(part.column("text")):
                    if held > RECORDS:
                        yield sent(found, int(blocks[a]))
                        found, held = [], 0
                    s, _ = segmenter(data, sizes)
                    begins = np.cumsum(sizes) - sizes
                    found.append({"anchor": s["anchor"], "segment": s["segment"], "doc": doc[k + s["text"]], "row": row[k + s["text"]].astype(np.uint32), "start": (s["start"] - begins[s["text"]]).astype(np.uint32), "n": np.zeros(len(s["text"]), np.uint32)})
                    held += len(s["text"])
                yield sent(found, int(blocks[a]))

    anchored = texts.select("doc", "row", "block", "text").mapInArrow(anchors, "owner long, block long, rows binary")
    verdicts = materialise(_owned(anchored, lambda t: recurring(_blobs(t))), "verdicts")

    def judge(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([batch_of([], "kind owner block rows bytes", MESSAGE_KINDS)])
        known = unpack(right.column("rows").to_pylist(), VERDICTS)
        return pa.Table.from_batches([batch_of(list(judged(key[0].as_py(), left, known, width, gram, owners)), "kind owner block rows bytes", MESSAGE_KINDS)])

    by_block = texts.select("doc", "row", "block", "text").groupBy("block")
    messages = materialise(by_block.cogroup(verdicts.groupBy("block")).applyInArrow(judge, MESSAGE), "messages")

    def sort(table: pa.Table) -> pa.Table:
        parts = [unpack([b], SEGMENTS) for b in table.column("rows").to_pylist()]
        of = np.repeat(table.column("block").to_numpy(), [len(p["row"]) for p in parts])
        return repeated_strings(joined(parts, SEGMENTS), of, np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8), width)

    again = _owned(messages.filter("kind = 'segments'"), sort).unionByName(_owned(messages.filter("kind = 'strings'"), lambda t: later_strings(_blobs(t), width)))
    spans = again.unionByName(messages.filter("kind = 'spans'").select("block", "rows"))

    def cut_out(left: pa.Table, right: pa.Table) -> pa.Table:
        gone = merged_spans(unpack(right.column("rows").to_pylist(), SPANS))
        out: list[list] = [[], [], []]
        for row, text in zip(left.column("row").to_pylist(), left.column("text").to_pylist()):
            a, b = np.searchsorted(gone["row"], [row, row + 1])
            starts, ends = gone["start"][a:b].tolist(), gone["end"][a:b].tolist()
            out[0].append(len(text))
            out[1].append([{"start": s, "end": e} for s, e in zip(starts, ends)])
            out[2].append(b"".join(text[e:s] for e, s in zip([0, *ends], [*starts, len(text)])) if starts else text)
        types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
        return pa.table([left.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, types))], names=["doc_id", "n_bytes", "spans", "kept"])

    whole = texts.select("doc_id", "row", "block", "text").groupBy("block")
    return whole.cogroup(spans.groupBy("block")).applyInArrow(cut_out, f"doc_id {id_type}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``remove_repeats`` returns."""
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
