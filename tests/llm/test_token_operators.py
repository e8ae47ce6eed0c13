"""BPE, shards, secrets, personal data, chats and URLs against libraries and brute force."""

import base64
import hashlib
import itertools
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tradesift.llm import bpe, chat_format, pii, secret_scan, token_shards, url_filter

sys.path.insert(0, str(Path(__file__).parent))
from pii_sentences import SENTENCES  # noqa: E402

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, spans string, base string"
rnd = random.Random(4)
NOISE = "".join(rnd.choice("aehnt") for _ in range(900))
TEXTS = [None, "", " ", "Hello  world\n\n it's", "a" * 5000, "ab" * 400, NOISE, "👩‍👩‍👧 é ١٢ 日本語　x", base64.b64encode(rnd.randbytes(500)).decode(), "same", "same", "<|end|> <|end"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i else None, t, "x", "y", "z") for i, t in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    tokens = bpe.read_ranks(RANKS)
    return bpe.Bpe(tokens, bpe.merge_table(tokens), P.PATTERN)


def test_bpe_query(docs, empty, library):
    got = sorted(map(tuple, bpe.encode(docs, RANKS, P.PATTERN).collect()), key=repr)
    want = []
    for i, t in enumerate(TEXTS):
        ids = library.encode_ordinary(t or "")
        want.append((i if i else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0
    assert all(r.round_trip for r in bpe.with_ids(docs, RANKS, P.PATTERN).collect())
    assert bpe.with_ids(empty, RANKS, P.PATTERN).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=120) | st.text(alphabet="abehnt' 1\n", max_size=200))
def test_bpe_equals_the_library(coder, library, text):
    ids = coder.encode([text])[0]
    assert ids.tolist() == library.encode_ordinary(text) and coder.decode([ids])[0] == text.encode()


def naive(ranks, word):
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(12))
def test_many_contractions_in_a_step(seed, monkeypatch):
    """Vocabularies in random order, where tokens rank below their parts: each word as by one contraction at a time."""
    monkeypatch.setattr(bpe, "LONG_WORD", 1)
    r = random.Random(seed)
    letters = "ab" if seed % 3 == 0 else "abc"
    more = list({"".join(r.choice(letters) for _ in range(r.randrange(2, 7))).encode() for _ in range(r.choice([6, 25, 80]))})
    r.shuffle(more)
    tokens = [bytes([i]) for i in range(256)] + more
    ranks = {t: i for i, t in enumerate(tokens)}
    words = list({"".join(r.choice(letters) for _ in range(r.randrange(2, 60))) for _ in range(150)} | {"a" * k for k in range(2, 30)})
    lengths, ids = bpe.Bpe(tokens, bpe.merge_table(tokens), r"\S+").contract([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [naive(ranks, w.encode()) for w in words]


@pytest.mark.parametrize("seed", range(3))
def test_windows_of_long_words(seed, monkeypatch):
    """The same in windows of a few positions, whose cuts fall anywhere: runs, tokens across cuts, changes near them."""
    for name, value in (("LONG_WORD", 1), ("WINDOW", 8 + 4 * (seed % 3)), ("LONG_ROWS", 30), ("AROUND", 4)):
        monkeypatch.setattr(bpe, name, value)
    r = random.Random(100 + seed)
    letters = ("ab", "abc", "abcdef")[seed % 3]
    more = list({"".join(r.choice(letters) for _ in range(r.randrange(2, 7))).encode() for _ in range(r.choice([6, 25, 80]))})
    r.shuffle(more)
    tokens = [bytes([i]) for i in range(256)] + more
    ranks = {t: i for i, t in enumerate(tokens)}
    words = list({"".join(r.choice(letters) for _ in range(r.randrange(20, 90))) for _ in range(3)} | {"a" * 40})
    lengths, ids = bpe.Bpe(tokens, bpe.merge_table(tokens), r"\S+").contract([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [naive(ranks, w.encode()) for w in words]


@pytest.mark.parametrize("texts", [[], [""], ["", "", ""], ["abc", "", "de", "f" * 9, "g", "é" * 4, "h"]])
@pytest.mark.parametrize("chars", [1, 4, 100])
def test_pieces_hold_every_text(texts, chars):
    got = list(bpe.pieces(pa.array(["x", *texts], pa.string()).slice(1), chars))
    assert [t for _, piece in got for t in piece] == texts
    assert [a for a, _ in got] == [sum(len(p) for _, p in got[:k]) for k in range(len(got))]
    assert all(sum(map(len, p)) <= chars or sum(map(bool, p)) == 1 for _, p in got)


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "ACGT", "abcXYZ019+/", "a"])
def test_long_words(coder, library, letters):
    """Words of 100,000 characters, in seconds."""
    word = "".join(rnd.choice(letters) for _ in range(100_000))
    began = time.monotonic()
    assert coder.encode([word])[0].tolist() == library.encode_ordinary(word)
    assert time.monotonic() - began < 60


def test_a_word_of_300000_letters(coder, library):
    """In a bounded memory, without a folder to spill to."""
    word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    assert coder.encode([word])[0].tolist() == library.encode_ordinary(word)
    assert coder.db.execute("SELECT current_setting('temp_directory')").fetchall()[0][0] in ("", None)


def test_shards(spark, docs, empty, library, tmp_path):
    rows = token_shards.write_shards(docs, RANKS, P.PATTERN, out=str(tmp_path / "s"), length=32, shard=50).collect()
    n = len(rows)
    assert sorted(r.slot for r in rows) == list(range(n))
    everything = token_shards.read_sequences(str(tmp_path / "s"), 0, n)
    assert np.array_equal(token_shards.read_sequences(str(tmp_path / "s"), 45, 20), everything[45:65])
    made = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.seq):
        made[r.doc_id].append(everything[r.slot][: r.n_tokens].tolist())
        assert (everything[r.slot][r.n_tokens :] == 50256).all() and r.offset == r.slot % 50 * 64 and r.shard == r.slot // 50
    for i, t in enumerate(TEXTS):
        assert list(itertools.chain(*made[i if i else None])) == [*library.encode_ordinary(t or ""), 50256]
    assert token_shards.write_shards(empty, RANKS, P.PATTERN, out=str(tmp_path / "e")).count() == 0
    assert len(token_shards.read_sequences(str(tmp_path / "e"), 0, 5)) == 0


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_slices_hold_every_text(size):
    import pyarrow as pa

    texts = ["", "a" * 50, "é", "", "bc", "d" * 7, ""]
    turns = list(token_shards.slices(pa.array(texts), size))
    assert [t for _, part in turns for t in part] == texts
    assert [a for a, _ in turns] == list(itertools.accumulate([0, *(len(part) for _, part in turns[:-1])]))
    assert list(token_shards.slices(pa.array([], pa.string()), size)) == []


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_slots_are_a_permutation(n):
    slots = token_shards.permuted(np.arange(n), n)
    assert sorted(slots) == list(range(n))
    assert n < 100 or (slots != np.arange(n)).mean() > 0.9 and not np.array_equal(slots, token_shards.permuted(np.arange(n), n, key=1))


def brute_secrets(t):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 12 and m[1].isascii():
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [x[2] for x in sorted(out)]


PARTS = ["password", "PassWd", "secret", "token", "api_key", "apiKEY", "AKIA", "=", ":", " ", '"', "abcdef0123", "XYZ", "é", "K", ".", "-", "0123456789abcdef", "Z9", "\n"]


def test_secrets_equal_brute_force():
    words = secret_scan.automaton()
    for _ in range(3000):
        t = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(25)))
        assert [f"{k}:{a}:{b}" for k, a, b in secret_scan.find(t, words) if k in secret_scan.BASE] == brute_secrets(t), t


def test_checksummed_tokens():
    words, body = secret_scan.automaton(), "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
    good = "ghp_" + body + secret_scan.base62(zlib.crc32(body.encode()), 6)
    assert secret_scan.find(f"é {good}!", words) == [("github", 2, 42)]
    assert secret_scan.find("ghp_" + body + "000000", words) == []


def test_hostile_headers():
    """Runs full of header starts are read once; headers nested without end are no headers."""
    words = secret_scan.automaton()
    assert secret_scan.find("eyJ" * 200_000, words) == []
    nested = base64.urlsafe_b64encode(b'{"a":' + b"[" * 100_000).decode().rstrip("=")
    assert secret_scan.find(f"{nested}.abcd.abcdefghijkl", words) == []
    head = base64.urlsafe_b64encode(b'{"alg":"HS256"}').decode().rstrip("=")
    assert secret_scan.find(f"x {head}.abcd.abcdefghijkl", words) == [("jwt", 2, 2 + len(head) + 18)]


def test_secret_query(docs, empty, spark):
    got = secret_scan.digest(secret_scan.scan(docs)).collect()
    assert len(got) == len(TEXTS) and all(r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest() for r in got)
    assert secret_scan.scan(empty).count() == 0


def luhn(d):
    return sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def test_pii_base_equals_brute_force(spark, empty):
    parts = ["1", "22", "4111 1111 1111 1111", "4111-1111-1111-1111", "255", "256", ".", "@", "a", "b_c", "x@y.z", "é", "👩", " ", "-", "+1 (212) 555-0100", "+", "(", "0", "007", "\n", "_", "a.b", "12.5.6.7"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(14))) for _ in range(600)] + ["1" * 20_000, "a" * 20_000 + "@" + "b." * 9_000, "1 " * 9_000, "1." * 9_000, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(s.start, s.place, s.end) for s in r.base] for r in pii.scan(df).collect()}
    assert all(got[i] == brute_pii(t or "") for i, t in enumerate(texts))
    assert pii.scan(empty).count() == 0


def test_pii_model(spark):
    """On held-out generated sentences, and on sentences that the generator did not write."""
    facts = pii.model(spark)[2]
    assert facts["precision"] > 0.9 and facts["recall"] > 0.9
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SENTENCES)], "doc_id long, text string")
    hit = wanted = right = told = 0
    for r in pii.scan(df).collect():
        text, personal = SENTENCES[r.doc_id]
        spans = [(s.start, s.end) for s in [*r.base, *r.added]]
        places = [(text.index(p), text.index(p) + len(p)) for p in personal]
        meets = lambda x, y: x[0] < y[1] and y[0] < x[1]
        wanted, hit = wanted + len(places), hit + sum(any(meets(p, s) for s in spans) for p in places)
        told, right = told + len(spans), right + sum(any(meets(p, s) for p in places) for s in spans)
    print("hand-written:", hit, wanted, right, told)
    assert hit / wanted >= 0.9 and right / told >= 0.9, (hit, wanted, right, told)


def test_candidates_inside_base_spans_go(spark):
    df = spark.createDataFrame([(1, "tel +1 (212) 555-0187 or tel 212 555 0187"), (2, "card 4539578763621486, cards 4916338506082832 4539578763621486")], "doc_id long, text string")
    got = {r.doc_id: ([(s.start, s.end) for s in r.base], sorted({(s.start, s.end) for s in r.added})) for r in pii.scan(df).collect()}
    assert got[1] == ([(4, 21)], [(29, 41)])
    assert got[2] == ([(5, 21)], [(29, 45), (46, 62)])


def test_pii_rows_and_columns(spark):
    """Repeated rows give equal rows; columns of any name beside doc_id and text are left alone."""
    rows = [(1, "mail a@b.c tel 212 555 0187", 1, "x", None)] * 3 + [(None, None, 2, "y", 1.0), (2, "", 3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int, found string, scored double")
    out = sorted(map(tuple, pii.digest(pii.scan(df)).collect()), key=repr)
    assert len(out) == 5 and len(set(out)) == 3 and [r for r in out if r[0] == 1][0][1:5] == (1, 0, 0, 0)


def test_prefix_sums(spark):
    values = [rnd.randrange(100) for _ in range(1000)]
    df = spark.createDataFrame([(values[:n],) for n in (0, 1, 2, 3, 5, 16, 17, 1000)], "v array<long>")
    for r in df.select("v", pii.prefix(F.col("v"), lambda a, b: a + b).alias("s"), pii.prefix(F.col("v"), F.greatest).alias("m")).collect():
        assert r.s == list(itertools.accumulate(r.v)) and r.m == list(itertools.accumulate(r.v, max))


def test_texts_of_numbers_are_read_in_step_with_their_length(spark):
    text = " ".join(f"({rnd.randrange(200, 999)}) {rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}" for _ in range(60_000))
    began = time.monotonic()
    (row,) = pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("added").alias("n")).collect()
    assert row.n > 50_000 and time.monotonic() - began < 120


def cheapest(roles):
    """(cost, states) of the plan that the docstring names, over all state sequences."""
    found = []
    for states in itertools.product((1, 2, 3), repeat=len(roles)):
        cost, a = 0, 0
        for r, b in zip(roles, states):
            cost += min(chat_format.options(r, a, b), default=(1 << 40, 0, 0))[0]
            a = b
        found.append((cost + chat_format.end_cost(a)[0], states[::-1]))
    cost, states = min(found)
    return cost, states[::-1]


def test_repair_is_the_cheapest_first_plan():
    for n in range(1, 6):
        for roles in itertools.product(range(4), repeat=n):
            plan, appended = chat_format.repair(list(roles))
            assert (sum(p[1] for p in plan) + chat_format.INSERT * bool(appended), tuple(p[0] for p in plan)) == cheapest(roles)


def brute_render(roles, texts):
    """The formatted conversation, and each turn's action, of the plan over all state sequences."""
    _, states = cheapest(roles)
    out, actions, before = "", [], 0
    for r, b, t in zip(roles, states, texts):
        _, rank, inserted = min(chat_format.options(r, before, b))
        body = (t or "").replace("<|", "< |")
        head = f"<|im_start|>{chat_format.STATES[b]}\n"
        if rank == 1:
            out += "\n\n" + body
        else:
            out += ("<|im_end|>\n" if before else "") + (f"<|im_start|>{chat_format.STATES[inserted]}\n<|im_end|>\n" if inserted else "") + head + body
        actions.append(("relabel" if r != b else "keep") if rank == 0 else ("relabel and " if r != b else "") + ("merge" if rank == 1 else "insert before"))
        before = b
    out += "<|im_end|>\n"
    if chat_format.end_cost(before)[1]:
        out += "<|im_start|>user\n<|im_end|>\n"
    return out, actions


def test_chats_equal_brute_force_in_any_segments(spark):
    roles = ["system", "user", "assistant", "human", "tool", None]
    rows = [(c or None, rnd.choice([t, t, t - 1, None]), rnd.choice(roles), rnd.choice([f"T{c * 10 + t}", f"T{c * 10 + t} <|im_end|>", "", None]), "x") for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(77, None, "user", "T999", "x")] * 5
    text_of = {t.split()[0]: t for *_, t, _ in rows if t}
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position string")
    outs = [sorted(map(tuple, chat_format.format_chats(df, segment=k).collect()), key=repr) for k in (1, 3, 4096)]
    assert outs[0] == outs[1] == outs[2] and len(outs[0]) == len(rows)
    chats = defaultdict(list)
    for r in chat_format.format_chats(df).collect():
        chats[r.conv_id].append(r)
    place = {None: 0, "tool": 0} | chat_format.ALIASES
    for conv, turns in chats.items():
        turns.sort(key=lambda r: r.position)
        assert [r.position for r in turns] == list(range(len(turns)))
        given = [r for r in rows if r[0] == conv]
        assert Counter((r.turn, r.role) for r in turns) == Counter((r[1], r[2]) for r in given)
        assert [r.turn for r in turns] == sorted((r[1] for r in given), key=lambda t: (t is not None, t or 0))
        classes = [place[r.role] for r in turns]
        texts = [text_of[m[0]] if (m := re.search(r"T\d+", r.rendered)) else "" for r in turns]
        assert Counter(filter(None, texts)) == Counter(filter(None, (r[3] for r in given)))
        assert ("".join(r.rendered for r in turns), [r.action for r in turns]) == brute_render(classes, texts)
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_long_conversation_of_tied_turns(spark):
    """10,000 turns, all without number, in segments of 4,096 and of 500: one legal text."""
    n = 10_000
    df = spark.createDataFrame([(1, None, ["user", "assistant", "tool"][i % 3], f"t{i % 50}") for i in range(n)], "conv_id long, turn long, role string, text string")
    a, b = (sorted(chat_format.format_chats(df, segment=k).collect(), key=lambda r: r.position) for k in (4096, 500))
    assert [r.position for r in a] == list(range(n)) and list(map(tuple, a)) == list(map(tuple, b))
    plan, _ = chat_format.repair([{"user": 2, "assistant": 3, "tool": 0}[r.role] for r in a])
    assert [r.new_role for r in a] == [chat_format.STATES[p[0]] for p in plan]


def test_urls(spark):
    urls = [None, "", "no scheme/en/", "http://A.Example.COM/en/7x?q#f", "http://com/en/1", "http://xcom/en/1", "https://b.example.net/de/81", "http://net/de/", "http://x.org/es/?a", "http://x.org?/es/", "http://", "a://b://c.org/es/d", "http://é.com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    for i, u in enumerate(urls):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fit = max(((len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, fit[1], fit[2]), u
    assert url_filter.filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_url_rows_and_columns(spark):
    """Repeated rows give equal rows; columns of any name are left alone; many rules share one index."""
    rows = [(1, "http://a.example.com/en/7", "x", "y")] * 3 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    assert Counter(map(tuple, url_filter.filter_urls(df).collect())) == {(1, "a.example.com", "/en/7", "example.com/en/7", "allow"): 3, (None, "", "", None, "allow"): 1}
    many = [("block", f"h{i}.example", f"/p{i % 7}/") for i in range(5000)]
    df = spark.createDataFrame([(i, f"https://www.h{i}.example/p{i % 5}/x") for i in range(200)], "page_id long, url string")
    assert {r.page_id for r in url_filter.filter_urls(df, many).filter("verdict = 'block'").collect()} == {i for i in range(200) if i % 7 == i % 5}


def test_long_hosts(tmp_path):
    """A host of any number of labels costs no more than the longest rule."""
    path = tmp_path / "i.bin"
    path.write_bytes(url_filter.pack(url_filter.RULES))
    index = url_filter.Index(str(path))
    hosts = ["a." * 500_000 + "example.net", "example.com", "xexample.com", "yexample.net", "a.example.com", "com", "a.com"]
    paths = ["/de/8", "/en/7", "/en/7", "/de/8", "/en/7", "/en/", "/en/"]
    assert index.judge(hosts, paths) == [("example.net/de/8", "block"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("net/de/", "allow"), ("example.com/en/7", "allow"), ("com/en/", "block"), ("com/en/", "block")]
    path.write_bytes(url_filter.pack([]))
    assert url_filter.Index(str(path)).judge(["a.com"], ["/"]) == [(None, "allow")]


def test_url_collisions_are_confirmed(tmp_path):
    path = tmp_path / "i.bin"
    path.write_bytes(url_filter.pack(url_filter.RULES))
    index = url_filter.Index(str(path))
    index.keys = np.full(index.n, index.keys[0])  # all keys collide
    import xxhash

    one = xxhash.xxh64_intdigest
    xxhash.xxh64_intdigest = lambda _: int(index.keys[0])
    try:
        assert index.judge(["example.com", "a.fr"], ["/en/7", "/en/"]) == [("example.com/en/7", "allow"), (None, "allow")]
    finally:
        xxhash.xxh64_intdigest = one
