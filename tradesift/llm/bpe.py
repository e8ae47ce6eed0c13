"""Byte-level BPE encoding and decoding by DuckDB queries, one database per partition.

Encoding: each text is split by the tokenizer's pattern. The different words of a batch become token-position rows, one
for each byte; a recursive query joins neighbours with the merge table and contracts each word's leftmost minimum-rank
pair, until no word has one. Long words contract many pairs in one step: those of which it is certain that no other
contraction can come before theirs or take their parts (see LONG_STEP). The result is that of one contraction at a time,
and a word of 100,000 letters takes some dozens of steps instead of tens of thousands. What is certain of a pair depends
on its neighbourhood only, and such contractions may be done in any order; so words beyond WINDOW positions are cut into
windows, in which pairs too near a cut are left alone, and the cuts move from pass to pass. Where no window has a certain
pair left, pairs of the least rank of the whole word are contracted, and their surroundings are looked at again. Recursion is cut into bounded rounds too, so
the working tables stay small however long a word is, and nothing is spilled. Decoding: position rows join the vocabulary
and an ordered aggregation puts each text's bytes together.

Defined cases: null text encodes as empty (no ids, the digest of nothing); empty text likewise; texts go through whole,
several at a time up to ENCODED characters, and words in groups of START_ROWS bytes, one at least; repeated rows and ties give equal rows; an empty table gives an empty result. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradesift.llm.common import text_of

LONG_WORD = 48
ROUNDS = 64
START_ROWS = 400_000
#: Positions of a long word that are contracted together, and of all words in one query; and around one that has changed.
WINDOW, LONG_ROWS, AROUND = 16_384, 40_000, 16
NONE = 2**31 - 1
#: Characters of a piece of texts; those that are encoded at a time, ids that are decoded at a time, and words that a task
#: remembers.
CHARS, ENCODED, IDS, REMEMBERED = 1_000_000, 2_000_000, 400_000, 500_000

#: Positions are unique over all words of a query, so one order serves every word.
SHORT_STEP = """
WITH RECURSIVE step AS (
  SELECT word, pos, tok, 0 AS depth FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT word, pos, tok, depth, lead(tok) OVER w AS next, lead(word) OVER w AS next_word, lag(pos) OVER w AS before
     FROM step WINDOW w AS (ORDER BY pos)),
   m AS MATERIALIZED (
     SELECT p.*, (m.id::BIGINT << 32) | pos AS pair FROM p LEFT JOIN merges m ON m.l = tok AND m.r = next AND next_word = word),
   least AS (SELECT word, min(pair) AS best FROM m WHERE pair IS NOT NULL GROUP BY word)
   SELECT m.word, pos, CASE WHEN pos = (best & 4294967295) THEN (best >> 32)::INTEGER ELSE tok END, depth + 1
   FROM m JOIN least USING (word)
   WHERE before IS DISTINCT FROM (best & 4294967295) AND depth < {rounds}))
"""
#: Places are pairs of neighbours; ``stop`` is where the left token ends. A pair is safe if it will certainly be contracted
#: as it stands: its rank is below its left neighbour's and not above its right one's (of a run of equal pairs every
#: other one counts), no token of the vocabulary could take one of its parts first, and none could take the new token
#: at a lower rank. Such tokens stand in the word (``spans``). One that takes a part ends where the left part ends and
#: begins before the left neighbour does, or begins where the right part begins and ends after the right neighbour does.
#: Then contractions before the pair's turn neither need its parts nor see a pair of the new token come first, so doing
#: it at once changes nothing else. The leftmost minimum-rank pair is safe by
#: definition, so is every pair of that rank, up to the first whose new token could merge at a lower rank.
#: Of a window that does not open or close its word the least rank is not known (-1), nor what stands beyond its cuts: the
#: first run, whose pairs may have others before them, and the last three places are left alone.
LONG_STEP = """
WITH RECURSIVE step AS (
  SELECT word, pos, tok, 0 AS depth FROM start
  UNION ALL
  (WITH p AS MATERIALIZED (
     SELECT word, pos, tok, depth, lag(tok) OVER w AS prev, lead(tok) OVER w AS next, lead(tok, 2) OVER w AS after,
            lag(pos) OVER w AS before, lead(pos) OVER w AS stop, coalesce(lead(pos, 2) OVER w, ends.stop) AS close, lead(pos, 3) OVER w AS beyond,
            row_number() OVER w AS place, count(*) OVER (PARTITION BY word) AS places, ends.opens, ends.closes
     FROM step JOIN ends USING (word) WINDOW w AS (PARTITION BY word ORDER BY pos)),
   m AS MATERIALIZED (SELECT p.*, m.id FROM p LEFT JOIN merges m ON m.l = tok AND m.r = next),
   least AS (SELECT word, CASE WHEN bool_and(opens AND closes) THEN min(id) ELSE -1 END AS best FROM m WHERE id IS NOT NULL GROUP BY word),
   hits AS MATERIALIZED (
     SELECT m.*, best, coalesce(id = best, false) AS hit, lag(id) OVER w AS left_id, lead(id) OVER w AS right_id
     FROM m JOIN least USING (word) WINDOW w AS (PARTITION BY word ORDER BY pos)),
   runs AS (SELECT *, sum((id IS DISTINCT FROM left_id)::INTEGER) OVER (PARTITION BY word ORDER BY pos) AS run FROM hits),
   turns AS MATERIALIZED (
     SELECT *, id IS NOT NULL AND row_number() OVER r % 2 = 1 AS turn, first_value(left_id) OVER r AS run_left
     FROM runs WINDOW r AS (PARTITION BY word, run ORDER BY pos)),
   taken AS (
     SELECT t.pos FROM turns t JOIN spans s ON s.stop = t.stop WHERE turn AND s.pos < t.before AND s.id <= t.id
     UNION SELECT t.pos FROM turns t JOIN spans s ON s.pos = t.stop WHERE turn AND s.stop > t.beyond AND s.id < t.id
     UNION SELECT t.pos FROM turns t JOIN spans s ON s.stop = t.close WHERE turn AND s.pos < t.pos AND s.id < t.id
     UNION SELECT t.pos FROM turns t JOIN spans s ON s.pos = t.pos WHERE turn AND s.stop > t.close AND s.id < t.id),
   risky AS (
     SELECT t.*, turn AND (taken.pos IS NOT NULL OR coalesce(run_left < t.id, false) OR coalesce(right_id < t.id, false)
                           OR NOT opens AND run = 1 OR NOT closes AND place > places - 3) AS bad,
            turn AND hit AND (a.l IS NOT NULL OR b.l IS NOT NULL OR c.l IS NOT NULL) AS risk
     FROM turns t LEFT JOIN taken ON taken.pos = t.pos
                  LEFT JOIN early a ON a.l = prev AND a.r = best AND a.id < best
                  LEFT JOIN early b ON b.l = best AND b.r = after AND b.id < best
                  LEFT JOIN early c ON c.l = best AND c.r = best AND c.id < best),
   picked AS (
     SELECT *, turn AND (sum(bad::INTEGER) OVER (PARTITION BY word, run ORDER BY pos) = 0
                         OR hit AND coalesce(sum(risk::INTEGER) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0) AS pick
     FROM risky),
   gone AS (SELECT *, lag(pick, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone, bool_or(pick) OVER (PARTITION BY word) AS going FROM picked)
   SELECT word, pos, CASE WHEN pick THEN id ELSE tok END, depth + 1 FROM gone WHERE going AND NOT gone AND depth < {rounds}))
"""
#: The rank of some pairs; and of contractions at rank ``best`` those whose new token could merge lower.
RANKS = "SELECT n, id FROM given JOIN merges USING (l, r)"
RISKS = """
SELECT n FROM given LEFT JOIN early a ON a.l = prev AND a.r = {best} AND a.id < {best}
                    LEFT JOIN early b ON b.l = {best} AND b.r = after AND b.id < {best}
                    LEFT JOIN early c ON c.l = {best} AND c.r = {best} AND c.id < {best}
WHERE a.l IS NOT NULL OR b.l IS NOT NULL OR c.l IS NOT NULL
"""
#: A word's rows at its last depth, and whether it may contract further.
LAST = """
SELECT word, pos, tok, depth = {rounds} AS more
FROM step JOIN (SELECT word, max(depth) AS depth FROM step GROUP BY word) USING (word, depth) ORDER BY pos
"""


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank, from a file of lines "base64 rank"."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge_table(tokens: list[bytes]) -> np.ndarray:
    """Rows (left, right, id) of all pairs of tokens whose bytes together are a token."""
    ranks = {t: i for i, t in enumerate(tokens)}
    rows = [(ranks[t[:k]], ranks[t[k:]], i) for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    return np.array(rows, np.int32).reshape(-1, 3)


class Long:
    """A word under contraction: its bytes, where its tokens begin and their ids."""

    def __init__(self, text: bytes, byte: np.ndarray):
        self.text, self.pos, self.tok = text, np.arange(len(text), dtype=np.int32), byte[np.frombuffer(text, np.uint8)].astype(np.int32)


class Bpe:
    """Encoder and decoder of one task."""

    def __init__(self, tokens: list[bytes], merges: np.ndarray, pattern: str):
        import duckdb
        import regex

        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.sizes = np.array([len(t) for t in tokens], np.int32)
        self.reach = int(self.sizes.max(initial=1))
        self.automaton = None
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": "1", "memory_limit": "200MB", "preserve_insertion_order": "false", "temp_directory": ""})
        #: Merges that rank below one of their parts.
        early = merges[(merges[:, 2] < merges[:, 0]) | (merges[:, 2] < merges[:, 1])]
        for name, rows in (("merges", merges), ("early", early)):
            self._put(name, l=rows[:, 0].copy(), r=rows[:, 1].copy(), id=rows[:, 2].copy())
        self._put("vocabulary", id=np.arange(len(tokens), dtype=np.int32), hex=pa.array([t.hex() for t in tokens], pa.string()))
        self.forget()

    def tokens_in(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and id of every token of three bytes or more that stands in ``text``, overlapping ones included."""
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for token, rank in self.ranks.items():
                if len(token) > 2:
                    self.automaton.add_word(token.decode("latin-1"), rank)
            self.automaton.make_automaton()
        found = list(self.automaton.iter(text.decode("latin-1")))
        ends = np.fromiter((e for e, _ in found), np.int32, len(found)) + 1
        ids = np.fromiter((i for _, i in found), np.int32, len(found))
        return (ends - self.sizes[ids]).astype(np.int32), ends, ids

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _put(self, name: str, **columns) -> None:
        self.db.register("_given", pa.table({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _given")
        self.db.unregister("_given")

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids in the words' order."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        size = np.array([len(w) for w in words], np.int64)
        done = [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        short = np.flatnonzero((whole < 0) & (size <= LONG_WORD))
        for now in np.split(short, np.flatnonzero(np.diff(np.cumsum(size[short]) // START_ROWS)) + 1) if len(short) else []:
            text = b"".join([words[i] for i in now.tolist()])
            rows = (np.repeat(now.astype(np.int32), size[now]), np.arange(len(text), dtype=np.int32), self.byte[np.frombuffer(text, np.uint8)])
            while len(rows[0]):
                word, pos, tok, more = self._steps(SHORT_STEP, *rows)
                done.append((word[~more], tok[~more]))
                rows = (word[more], pos[more], tok[more])
        for i, tok in self._contract_long({i: words[i] for i in np.flatnonzero((whole < 0) & (size > LONG_WORD)).tolist()}):
            done.append((np.full(len(tok), i), tok))
        word = np.concatenate([x[0] for x in done])
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(words)).astype(np.int64), np.concatenate([x[1] for x in done])[order].astype(np.int32)

    def _steps(self, step: str, word: np.ndarray, pos: np.ndarray, tok: np.ndarray) -> list[np.ndarray]:
        """word, pos, tok and more (may contract further) after ROUNDS steps at most."""
        self._put("start", word=word, pos=pos, tok=tok)
        got = self.db.execute((step + LAST).format(rounds=ROUNDS)).fetchnumpy()
        return [np.asarray(got[k]) for k in ("word", "pos", "tok", "more")]

    def _contract_long(self, words: dict[int, bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """The ids of each word."""
        open_ = {}
        for i, text in words.items():
            word = Long(text, self.byte)
            if len(text) > WINDOW and self._shorten(word):
                yield i, word.tok
            else:
                open_[i] = word
        while open_:
            left = {}
            for (i, word), (pos, tok, more) in zip(open_.items(), self._windows([(w, 0, len(w.pos)) for w in open_.values()])):
                if more and len(tok):
                    word.pos, word.tok = pos, tok
                    left[i] = word
                else:
                    yield i, tok
            open_ = left

    def _shorten(self, word: Long) -> bool:
        """Contract a word until WINDOW positions are left, or no pair has a rank; whether the latter."""
        for first in (WINDOW, WINDOW // 2):
            while len(word.pos) > WINDOW:
                cuts = [0, *range(first, len(word.pos), WINDOW), len(word.pos)]
                if not len(self._contract(word, list(zip(cuts, cuts[1:])))):
                    break
        rank = self._ranks(word, np.arange(len(word.tok)))
        while len(word.tok) > WINDOW:
            best = int(rank.min())
            if best == NONE:
                return True
            hits = np.flatnonzero(rank == best)
            new = np.append(True, np.diff(hits) != 1)
            hits = hits[(np.arange(len(hits)) - np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))) % 2 == 0]
            risky = np.flatnonzero(self._risky(word, hits, best))
            hits = hits[: int(risky[0]) + 1] if len(risky) else hits
            kept = np.ones(len(word.tok), bool)
            kept[hits + 1] = False
            word.tok[hits] = best
            word.pos, word.tok, rank = word.pos[kept], word.tok[kept], rank[kept]
            changed = hits - np.arange(len(hits))
            while len(changed):
                again = np.unique(np.concatenate((changed, np.maximum(changed - 1, 0))))
                rank[again] = self._ranks(word, again)
                a, b = np.maximum(changed - AROUND, 0), np.minimum(changed + AROUND + 1, len(word.tok))
                cut = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                before = word.pos
                changed = self._contract(word, list(zip(a[cut].tolist(), b[np.append(cut[1:], len(b)) - 1].tolist())))
                rank = rank[np.searchsorted(before, word.pos)]
        return False

    def _ranks(self, word: Long, at: np.ndarray) -> np.ndarray:
        """Of the pairs that begin at some places."""
        out = np.full(len(at), NONE, np.int64)
        at = at[at < len(word.tok) - 1]
        for k in range(0, len(at), LONG_ROWS):
            part = at[k : k + LONG_ROWS]
            self._put("given", n=np.arange(k, k + len(part), dtype=np.int32), l=word.tok[part], r=word.tok[part + 1])
            got = self.db.execute(RANKS).fetchnumpy()
            out[np.asarray(got["n"])] = np.asarray(got["id"])
        return out

    def _risky(self, word: Long, hits: np.ndarray, best: int) -> np.ndarray:
        out = np.zeros(len(hits), bool)
        tok = np.concatenate(([-1], word.tok, [-1, -1])).astype(np.int32)
        for k in range(0, len(hits), LONG_ROWS):
            part = hits[k : k + LONG_ROWS]
            self._put("given", n=np.arange(k, k + len(part), dtype=np.int32), prev=tok[part], after=tok[part + 3])
            out[np.asarray(self.db.execute(RISKS.format(best=best)).fetchnumpy()["n"])] = True
        return out

    def _contract(self, word: Long, windows: list[tuple[int, int]]) -> np.ndarray:
        """Contract what is certain in some windows of a word; the places whose tokens are new."""
        kept, new = np.ones(len(word.pos), bool), np.zeros(len(word.pos), bool)
        before = word.pos
        for (a, b), (pos, tok, _) in zip(windows, self._windows([(word, a, b) for a, b in windows])):
            if 0 < len(pos) < b - a:
                at = np.searchsorted(before, pos)
                kept[a:b] = False
                kept[at] = True
                new[at] = word.tok[at] != tok
                word.tok[at] = tok
        word.pos, word.tok = word.pos[kept], word.tok[kept]
        return np.flatnonzero(new[kept])

    def _windows(self, windows: list[tuple[Long, int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Positions and ids of windows (word, first place, place after the last) after steps that are certain, and whether
        more may follow. Each is laid out by itself, with the bytes around it that a token could reach."""
        size = np.cumsum([b - a for _, a, b in windows])
        for now in np.split(np.arange(len(windows)), np.flatnonzero(np.diff(size // LONG_ROWS)) + 1) if windows else []:
            laid, ends, spans, base = [], [], [], 0
            for k, (word, a, b) in enumerate(windows[now[0] : now[-1] + 1]):
                stop = int(word.pos[b]) if b < len(word.pos) else len(word.text)
                low, high = max(0, int(word.pos[a]) - self.reach), min(len(word.text), stop + self.reach)
                laid.append((np.full(b - a, k, np.int32), word.pos[a:b] + np.int32(base - low), word.tok[a:b], base - low))
                ends.append((k, base - low + stop, a == 0, b == len(word.pos)))
                spans.append([x + (base if n < 2 else 0) for n, x in enumerate(self.tokens_in(word.text[low:high]))])
                base += high - low
            self._put("ends", **{c: np.array([e[n] for e in ends], t) for n, (c, t) in enumerate((("word", np.int32), ("stop", np.int32), ("opens", bool), ("closes", bool)))})
            self._put("spans", **{c: np.concatenate([s[n] for s in spans]).astype(np.int32) for n, c in enumerate(("pos", "stop", "id"))})
            word, pos, tok, more = self._steps(LONG_STEP, *(np.concatenate([x[n] for x in laid]) for n in range(3)))
            edges = np.searchsorted(word, np.arange(len(laid) + 1))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                yield pos[a:b] - np.int32(laid[k][3]), tok[a:b], bool(more[a:b].any())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.index) > REMEMBERED:
            self.forget()
        split = [self.split(t) for t in texts]
        index = self.index
        fresh = list({w for words in split for w in words if w not in index})
        if fresh:
            lengths, found = self.contract([w.encode("utf-8") for w in fresh])
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(lengths) - lengths))
            self.lengths = np.concatenate((self.lengths, lengths))
            self.ids = np.concatenate((self.ids, found))
            index.update(zip(fresh, range(len(index), len(index) + len(fresh))))
        out = []
        for words in split:
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
            lengths = self.lengths[at]
            ends = np.cumsum(lengths)
            total = int(ends[-1]) if len(ends) else 0
            out.append(self.ids[np.repeat(self.starts[at] - (ends - lengths), lengths) + np.arange(total)])
        return out

    def decode(self, sequences: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        if not sequences:
            return []
        lengths = np.array([len(x) for x in sequences], np.int64)
        doc = np.repeat(np.arange(len(sequences), dtype=np.int32), lengths)
        ids = np.concatenate(sequences).astype(np.int32)
        parts: list[list[bytes]] = [[] for _ in sequences]
        for k in range(0, len(ids), IDS):
            self._put("given", doc=doc[k : k + IDS], pos=np.arange(len(ids[k : k + IDS]), dtype=np.int32), id=ids[k : k + IDS])
            for d, text in self.db.execute("SELECT doc, string_agg(hex, '' ORDER BY pos) FROM given JOIN vocabulary USING (id) GROUP BY doc").fetchall():
                parts[d].append(bytes.fromhex(text))
        return [b"".join(p) for p in parts]


def pieces(texts: pa.Array, chars: int = CHARS, raw: bool = False) -> Iterator[tuple[int, list[str]]]:
    """First row and texts of ranges of about ``chars`` characters, one text at least: no more of them are Python strings
    (``raw``: UTF-8 bytes) at a time."""
    lengths = pc.utf8_length(texts).to_pylist()
    texts = texts.cast(pa.binary()) if raw else texts
    a = size = 0
    for b, n in enumerate(lengths):
        if size and size + n > chars:
            yield a, texts.slice(a, b - a).to_pylist()
            a, size = b, 0
        size += n
    if a < len(lengths):
        yield a, texts.slice(a).to_pylist()


def loaded(docs: DataFrame, path: str):
    """The tokenizer's tables as a broadcast: a vocabulary has a fixed size, whatever the corpus."""
    tokens = read_ranks(path)
    return docs.sparkSession.sparkContext.broadcast((tokens, merge_table(tokens)))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per row of ``docs``."""
    given = loaded(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(*given.value, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in pieces(batch.column(1), ENCODED):
                coded = bpe.encode(texts)
                n += [len(x) for x in coded]
                ids_sha += [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in coded]
                text_sha += [hashlib.sha256(x).hexdigest() for x in bpe.decode(coded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def with_ids(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int), round_trip (the ids decode to the text's bytes)."""
    given = loaded(docs, path)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(*given.value, pattern)
        for batch in batches:
            for a, texts in pieces(batch.column(1), ENCODED):
                coded = bpe.encode(texts)
                same = [x == t.encode("utf-8") for x, t in zip(bpe.decode(coded), texts)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in coded]))), pa.int32()), pa.array(np.concatenate(coded), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(texts)), pa.array([len(x) for x in coded], pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids array<int>, round_trip boolean")
