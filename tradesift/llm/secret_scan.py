"""Secret scans: a keyword automaton first, anchored regular expressions only near its hits, then checksums.

One Aho-Corasick pass over a text finds the keywords; at each hit one regular expression is tried at that place. Long hex
runs have no keyword: the text is mapped to its character class and searched for a run of sixteen. Texts are scanned as
one byte per code point, other than ASCII as "?", so offsets are code points. Tokens whose format embeds a checksum are
reported only if it holds.

Kinds of the base contract: assign, access, hex. Added by the method: github and npm (CRC32 of the body in base 62 at
the end), jwt (a header that decodes to a JSON object with "alg").

Defined cases: null text counts as empty and has no spans; spans of one kind never overlap, spans of different kinds
may; repeated rows give equal rows; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.llm.common import text_of

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt")
#: Keywords in lower case, each with the kind that is tried at a hit.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt",
}
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = {"github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"), "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")}
#: Starts where a run does, so one run is read once however many headers it seems to hold.
JWT = re.compile(rb"(?<![0-9A-Za-z_-])(eyJ[0-9A-Za-z_-]{5,}+)\.[0-9A-Za-z_-]{2,}\.[0-9A-Za-z_-]{10,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
HEX_CLASS = bytes(ord("h") if c in b"0123456789abcdef" else 32 for c in range(256))
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, k = divmod(n, 62)
        out = DIGITS[k] + out
    return out.rjust(width, "0")


def checksum_holds(body: bytes, check: bytes) -> bool:
    return base62(zlib.crc32(body), 6).encode() == check


def is_jwt_header(part: bytes) -> bool:
    try:
        found = json.loads(base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4)))
    except (ValueError, RecursionError):  # not JSON, or nested without end
        return False
    return isinstance(found, dict) and "alg" in found


def automaton():
    import ahocorasick

    made = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        made.add_word(word, (len(word), kind))
    made.make_automaton()
    return made


def find(text: str, words) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind. ``words``: the automaton."""
    raw = text.encode("ascii", "replace")
    spans: list[tuple[str, int, int]] = []
    done = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - length, kind) for end, (length, kind) in words.iter(raw.lower().decode("ascii")))
    for at, kind in hits:
        if at < done[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(raw, at):
                done[kind] = m.end()
                if m.end(1) - m.start(1) >= LEAST_ASSIGN:
                    spans.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(raw, at):
                done[kind] = m.end()
                if m.end() - at >= LEAST_ACCESS:
                    spans.append((kind, at, m.end()))
        elif kind == "jwt":
            if (m := JWT.match(raw, at)) and is_jwt_header(m[1]):
                done[kind] = m.end()
                spans.append((kind, at, m.end()))
        elif (m := CHECKED[kind].match(raw, at)) and checksum_holds(m[1], m[2]):
            done[kind] = m.end()
            spans.append((kind, at, m.end()))
    classes, run = raw.translate(HEX_CLASS), b"h" * LEAST_HEX
    at = classes.find(run)
    while at >= 0:
        end = HEX.match(raw, at).end()
        spans.append(("hex", at, end))
        at = classes.find(run, end)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py(), words)] for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], ["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end by start, then kind): one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(_scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of what ``scan`` returns."""
    spans = F.col("spans")
    of = lambda *kinds: F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(spans).alias("spans"))
