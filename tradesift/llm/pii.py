"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select redactions.

All of it is built-in column expressions. The base kinds (email, ip, card, phone) are fixed formats and always stay.
High-recall generators propose further spans, which may overlap: local phone numbers, national ids, account numbers,
written-out addresses and long digit runs (card numbers inside longer runs of digits among them). Candidates inside a
base span go. Each other one gets format features (digits, letters, separators, shape, checksums) and context features
(words before it, near and further off); gradient-boosted trees, fitted on the driver from a small generated sample of
labelled sentences (TRAIN_SENTENCES of them, a parameter) and compiled into one expression, give its score. The threshold
of a kind is the lowest that keeps PRECISION on the held-out third. A span may stay under two kinds.

Offsets are code points: splitting a text at a pattern gives the gaps between its matches, and running sums of gap and
match lengths are their places. Patterns are written so that no input makes them backtrack beyond a run, and sums run by
blocks, so a text that is all numbers takes time nearly in step with its length.

Defined cases: null text counts as empty and has no spans; base spans of one kind never overlap; repeated rows give equal
rows; an empty table gives an empty result. Only doc_id and text are read by ``scan``.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.llm.common import let, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("local_phone", "national_id", "account", "written_email", "long_number")
LOCAL = "[A-Za-z0-9._%+-]"
#: A match may start where the last one ended or where a run begins; later starts in a run could not succeed either.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Whole digit runs with single separators, of 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GENERATORS = {
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}[\x20-][0-9]{2,3}[\x20-][0-9]{3,4}(?![0-9A-Za-z-]|\.[0-9])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "written_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[A-Za-z]{2,24}",
    "long_number": r"(?<![0-9A-Za-z.-])[0-9]{9,19}(?![0-9A-Za-z-]|\.[0-9])",
}
#: A cheap test that a text can hold a match at all.
NEEDED = {
    "email": lambda t: F.contains(t, F.lit("@")), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), "phone": lambda t: F.contains(t, F.lit("+")),
    "written_email": lambda t: t.rlike(r"[\[(]\x20?at\x20?[\])]"),
}
DIGIT_RUN = r"[0-9][\x20()./A-Z-]{0,3}[0-9]{2}"
CONTEXT = 32
#: Characters before a span that count as right next to it.
NEAR = 14
WORDS = {
    "phone": r"(?i)\b(?:phone|tel|telephone|mobile|mob|cell|call|fax|reach|contact|whatsapp|ring|text|dial|hotline|landline)\b",
    "id": r"(?i)\b(?:ssn|social|passport|national|tax|taxpayer|identity|insurance|licen[cs]e|dni|nif|id|nhs|medicare)\b",
    "money": r"(?i)\b(?:iban|account|acct|bank|card|visa|mastercard|amex|credit|debit|wire|deposit|payee|transfer)\b",
    "mail": r"(?i)\b(?:e-?mail|mail|write|reach|contact|send|address|message)\b",
    "thing": r"(?i)\b(?:order|invoice|version|isbn|serial|part|page|item|build|total|units|model|ticket|case|ref|reference|sku|tracking|batch|lot|code|article|score|population|catalogue|firmware|patent|room|row)\b",
}
SHAPES = {
    "brackets": r"[()]",
    "phone_shape": r"^\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-]?[0-9]{4}$|^\(?0[0-9]{2,3}\)?[\x20./-]",
    "id_shape": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "card_start": r"^[3-6]",
    "written_dot": r"(?i)[\[(]\x20?dot\x20?[\])]",
}
FEATURES = ("kind", "length", "digits", "letters", "separators", "luhn", "mod97", *SHAPES, *[f"{w}_words" for w in WORDS], *[f"{w}_near" for w in WORDS], "before_end", "closed")
TRAIN_SENTENCES, TREES, DEPTH, RATE, PRECISION, SEED = 4_000, 40, 4, 0.3, 0.95, 7

SPAN = "array<struct<start:bigint,end:bigint,m:string,before:string,after:string>>"
NUMBERS = "array<bigint>"


def prefix(values: Column, combine) -> Column:
    """All running sums (or maxima) of an array of whole numbers, by blocks of about the square root of its size: arrays
    that grow by appending are copied at each step, so none grows beyond a block."""

    def inside(block: Column) -> Column:
        return F.aggregate(block, F.array().cast(NUMBERS), lambda acc, x: F.array_append(acc, combine(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)), x)))

    def whole(given: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(given))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(given) - 1) / step).cast("int")), lambda k: inside(F.slice(given, k * step + 1, step)))
        bases = lambda parts: let(inside(F.transform(parts, lambda p: F.element_at(p, -1))), lambda tops: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: combine(x, F.coalesce(F.get(tops, k - 1), F.lit(0)))))))
        return let(blocks, bases)

    return let(values, lambda given: F.when(F.size(given) > 0, whole(given)).otherwise(F.array().cast(NUMBERS)))


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places and what stands around them."""

    def spans(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(gaps, i))).cast("bigint"))

        def span(ends: Column):
            return lambda m, i: F.struct(
                (F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("m"), F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")
            )

        return let(prefix(steps, lambda a, b: a + b), lambda ends: F.transform(found, span(ends)))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps))))


def if_needed(text: Column, needed: Column, spans: Column) -> Column:
    return F.when(needed, spans).otherwise(F.array().cast(SPAN))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def base_spans(text: Column) -> dict[str, Column]:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)

    return {
        "email": if_needed(text, NEEDED["email"](text), matches(text, EMAIL)),
        "ip": F.filter(if_needed(text, NEEDED["ip"](text), matches(text, IP)), lambda s: F.forall(F.split(s["m"], r"\."), small)),
        "card": F.filter(if_needed(text, text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"), matches(text, CARD)), lambda s: F.call_function("luhn_check", digits_of(s["m"]))),
        "phone": F.filter(if_needed(text, NEEDED["phone"](text), matches(text, PHONE)), lambda s: F.length(digits_of(s["m"])).between(9, 15)),
    }


def mod97(s: Column) -> Column:
    """1 if an account number's check digits hold: letters count 10 to 35, the first four characters go last."""
    bare = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))
    step = lambda acc, c: (acc * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)) % 97
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$"), (F.aggregate(F.split(turned, "(?!^)"), F.lit(0), step) == 1).cast("int")).otherwise(0)


def features(s: Column) -> Column:
    near = F.right(s["before"], F.lit(NEAR))
    about = F.concat_ws(" ", s["before"], s["after"])
    digits = digits_of(s["m"])
    return F.struct(
        s["k"].cast("double").alias("kind"),
        F.length(s["m"]).cast("double").alias("length"),
        F.length(digits).cast("double").alias("digits"),
        F.length(F.regexp_replace(s["m"], "[^A-Za-z]", "")).cast("double").alias("letters"),
        F.length(F.regexp_replace(s["m"], "[^\\x20().-]", "")).cast("double").alias("separators"),
        ((F.length(digits) >= 12) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))).cast("double").alias("luhn"),
        mod97(s["m"]).cast("double").alias("mod97"),
        *[s["m"].rlike(rx).cast("double").alias(name) for name, rx in SHAPES.items()],
        *[(about if name == "thing" else s["before"]).rlike(rx).cast("double").alias(f"{name}_words") for name, rx in WORDS.items()],
        *[near.rlike(rx).cast("double").alias(f"{name}_near") for name, rx in WORDS.items()],
        s["before"].rlike(r"[:#=]\x20?$").cast("double").alias("before_end"),
        s["after"].rlike(r"^[\x20.,;)\n]|^$").cast("double").alias("closed"),
    )


def candidates(text: Column) -> Column:
    """array of (k, start, end, m, before, after) of all generators; k is the place in ADDED."""
    numeric = text.rlike(DIGIT_RUN)
    lists = []
    made = lambda k: lambda s: F.struct(F.lit(k).alias("k"), *[s[c].alias(c) for c in ("start", "end", "m", "before", "after")])
    for k, name in enumerate(ADDED):
        found = if_needed(text, NEEDED[name](text) if name in NEEDED else numeric, matches(text, GENERATORS[name]))
        lists.append(F.transform(found, made(k)))
    return F.concat(*lists)


def outside(found: Column, base: Column) -> Column:
    """Candidates that no base span contains: in the order of starts, how far have base spans come?"""

    def merged(cands: Column) -> Column:
        marks = F.concat(
            F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), F.lit(0).alias("i"))),
            F.transform(cands, lambda c, i: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"), i.alias("i"))),
        )

        def free(sorted_marks: Column) -> Column:
            reach = prefix(F.transform(sorted_marks, lambda m: F.when(m["own"] == 0, m["end"]).otherwise(0).cast("bigint")), F.greatest)
            told = lambda r: F.filter(F.transform(sorted_marks, lambda m, i: F.struct(m["i"].alias("i"), ((m["own"] == 1) & (F.get(r, i) < m["end"])).alias("free"))), lambda m: m["free"])
            return F.transform(let(reach, told), lambda m: F.get(cands, m["i"]))

        return F.when((F.size(cands) == 0) | (F.size(base) == 0), cands).otherwise(let(F.sort_array(marks), free))

    return let(found, merged)


# ---- the model


PLAIN = "the a my our for to of on in at is was with from please now today new old best kindly this that her his their next first".split()
#: Words before personal data, and before numbers that are none. Some stand in both lists.
LEADS = {
    "phone": "phone|tel|call me at|mobile:|contact|fax|ring|cell|reach us on|tel.|whatsapp|dial|text me on|phone no.|landline".split("|"),
    "id": "ssn|social security number|national id:|passport|tax id|identity card|driving licence|insurance no.|dni|id:".split("|"),
    "bank": "iban|account:|bank|wire to|account number|deposit to|payee account|acct".split("|"),
    "card": "card|visa|credit card:|debit card|mastercard|amex|paid with card|card number".split("|"),
    "mail": "email|write to|contact|mail:|e-mail me:|send it to|reach me:|address:".split("|"),
    "thing": "order|invoice|ticket|ref|part|serial|isbn|version|build|total|units|tracking|batch|lot|case|item|sku|model|article|catalogue|reference".split("|"),
    "both": "contact ref|call centre ticket|bank case|card order|phone model|passport page|account invoice|id code|fax item|mail batch".split("|"),
}


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def sentences(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, personal) of generated sentences that each hold one number or address. Formats are shared by
    both labels; leads may lack, stand apart from the value, or mislead."""
    rnd = random.Random(seed)
    pick = rnd.choice
    num = lambda k: "".join(pick("0123456789") for _ in range(k))
    made_up = lambda: "".join(pick(("an", "er", "tion", "ou", "le", "en", "de", "st", "la", "ing")) for _ in range(rnd.randint(1, 3)))
    word = lambda: pick(PLAIN) if rnd.random() < 0.5 else made_up()

    def iban(right: bool) -> str:
        country = pick(("DE", "FR", "ES", "IT", "NL", "GB"))
        body = num(pick((14, 18, 20))) if country != "GB" else "NWBK" + num(14)
        value = "".join(str(int(c, 36)) for c in body + country + "00")
        check = 98 - int(value) % 97 if right else rnd.randint(10, 99)
        whole = f"{country}{check:02d}{body}"
        return whole if rnd.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def card() -> str:
        body = pick("3456") + num(pick((13, 14, 14, 14, 15)))
        return body + luhn_digit(body)

    def phone() -> str:
        area, mid, end = pick("23456789") + num(2), num(3), num(4)
        return pick((f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area} {mid} {end}", f"{area}.{mid}.{end}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"{mid} {end}".join(("0" + num(2) + "/", ""))))

    def national() -> str:
        return pick((f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)} {num(2)} {num(4)}", num(9), num(10)))

    def written() -> str:
        at = pick((" [at] ", " (at) ", "[at]", "(at)"))
        return made_up() + at + made_up() + pick((" [dot] ", " (dot) ", "[dot]", "(dot)", ".")) + pick(("com", "org", "net", "de"))

    def thing() -> str:
        return pick((num(rnd.randint(9, 19)), num(16), num(13), f"{num(3)}-{num(3)}-{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(3)} {num(3)} {num(4)}", f"{num(2)} {num(4)} {num(4)}", iban(False), f"QX{num(2)} {num(4)} {num(4)}"))

    # What it is, how often, its lead words and how often it has one, and whether it is personal.
    kinds = (
        (phone, 14, "phone", 0.8, 1), (national, 9, "id", 0.95, 1), (lambda: iban(True), 8, "bank", 0.6, 1), (lambda: num(rnd.randint(9, 12)), 5, "bank", 1.0, 1),
        (card, 9, "card", 0.5, 1), (written, 7, "mail", 0.6, 1), (thing, 20, "thing", 0.7, 0), (thing, 8, "both", 1.0, 0), (phone, 4, "thing", 0.9, 0),
        (national, 4, "thing", 0.9, 0), (lambda: num(16), 6, "thing", 0.0, 0), (lambda: num(rnd.randint(9, 19)), 4, "thing", 0.0, 0), (lambda: f"{made_up()} (at) {made_up()}. {made_up().title()}", 4, "mail", 0.2, 0),
    )
    out = []
    for _ in range(n):
        make, _, lead, often, personal = rnd.choices(kinds, [k[1] for k in kinds])[0]
        head = [word() for _ in range(rnd.randint(0, 4))]
        if rnd.random() < 0.12:  # a word of another class further away
            head.insert(0, pick(LEADS[pick(tuple(LEADS))]))
        if rnd.random() < often:
            head += [pick(LEADS[lead])] + [word() for _ in range(pick((0, 0, 0, 1, 2)))]
        start = " ".join(head) + pick((" ", " ", " ", ": ", " #", " is ", "\n")) if head else ""
        value = make()
        out.append((start + value + pick((".", " ", ",", "", ")", ";")) + pick((" ", "")) + " ".join(word() for _ in range(rnd.randint(0, 3))), len(start), len(start) + len(value), personal))
    return out


def fit_tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree on the gradient: (feature, threshold, left, right) or a leaf's value."""
    leaf = float(grad.sum() / (hess.sum() + 1.0))
    if depth == 0 or len(grad) < 20:
        return leaf
    best, choice = grad.sum() ** 2 / (hess.sum() + 1.0) + 1e-6, None
    for j in range(x.shape[1]):
        for t in np.unique(x[:, j])[:-1]:
            low = x[:, j] <= t
            gain = grad[low].sum() ** 2 / (hess[low].sum() + 1.0) + grad[~low].sum() ** 2 / (hess[~low].sum() + 1.0)
            if gain > best:
                best, choice = gain, (j, float(t), low)
    if choice is None:
        return leaf
    j, t, low = choice
    return j, t, fit_tree(x[low], grad[low], hess[low], depth - 1), fit_tree(x[~low], grad[~low], hess[~low], depth - 1)


def value_of(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, t, low, high = tree
    return np.where(x[:, j] <= t, value_of(low, x), value_of(high, x))


@functools.lru_cache(maxsize=4)
def _fitted(app: str, n: int, seed: int, rounds: int):
    spark = SparkSession.getActiveSession()
    made = sentences(n, seed)
    rows = ", ".join(f"({i}, '{t}', {a}, {b}, {y})" for i, (t, a, b, y) in enumerate(made)).replace("\n", "\\n")
    given = spark.sql(f"SELECT * FROM VALUES {rows} AS v(i, text, a, b, y)")
    found = given.select("i", "a", "b", "y", F.explode(candidates(F.col("text"))).alias("c")).filter("c.start < b AND c.end > a")
    found = found.select("i", "y", features(F.col("c")).alias("f"))
    # At most n sentences times the generators: a bounded sample.
    got = found.select("i", "y", *[f"f.{name}" for name in FEATURES]).orderBy("i", *FEATURES).collect()
    x = np.array([[r[name] for name in FEATURES] for r in got], float)
    y = np.array([r["y"] for r in got], float)
    held = np.array([r["i"] % 3 == 0 for r in got])
    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = fit_tree(x[~held], (y - p)[~held], (p * (1 - p))[~held], DEPTH)
        trees.append(tree)
        score += RATE * value_of(tree, x)
    cuts = []
    for k in range(len(ADDED)):
        mine = held & (x[:, 0] == k)
        order = np.argsort(-score[mine], kind="stable")
        sorted_scores = score[mine][order]
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        # A threshold takes all candidates of its score.
        whole = np.append(sorted_scores[1:] != sorted_scores[:-1], True) if mine.any() else np.zeros(0, bool)
        fit = np.flatnonzero((right >= PRECISION) & whole)
        cuts.append(float(sorted_scores[fit[-1]]) if len(fit) else float("inf"))
    limit = np.array(cuts)[x[:, 0].astype(int)]
    chosen = held & (score >= limit)
    facts = {"precision": float(y[chosen].mean()), "recall": float(y[chosen].sum() / y[held].sum()), "held": int(held.sum())}
    return tuple(trees), tuple(cuts), facts


def model(spark: SparkSession, n: int = TRAIN_SENTENCES, seed: int = SEED, rounds: int = TREES):
    """Trees, a threshold for each added kind, and precision and recall at the thresholds on the held-out third."""
    return _fitted(spark.sparkContext.applicationId, n, seed, rounds)


def compiled(trees, f: str) -> str:
    """The trees' sum as one SQL expression over the struct ``f`` of features."""

    def branch(tree) -> str:
        if isinstance(tree, float):
            return f"{RATE * tree!r}D"
        j, t, low, high = tree
        return f"CASE WHEN {f}.{FEATURES[j]} <= {t!r}D THEN {branch(low)} ELSE {branch(high)} END"

    return " + ".join(map(branch, trees))


# ---- the operator


def scan(docs: DataFrame, sentences_to_fit: int = TRAIN_SENTENCES) -> DataFrame:
    """doc_id, base, added: arrays of (start, place of the kind, end, kind) in order; one row per row of ``docs``."""
    trees, cuts, _ = model(docs.sparkSession, sentences_to_fit)
    text = text_of()
    plain = lambda place, kind: lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind"))
    base = F.concat(*[F.transform(found, plain(i, kind)) for i, (kind, found) in enumerate(base_spans(text).items())])

    free = outside(F.col("found"), F.col("base"))
    scored = F.transform(free, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), features(c).alias("f")))
    found = docs.select("doc_id", F.sort_array(base).alias("base"), candidates(text).alias("found")).select("doc_id", "base", scored.alias("scored"))
    limits = "CASE " + " ".join(f"WHEN c.k = {k} THEN {c!r}D" for k, c in enumerate(cuts) if c != float("inf")) + " END"
    kinds = ", ".join(f"'{k}'" for k in ADDED)
    span = f"named_struct('start', c.start, 'place', c.k + {len(BASE)}, 'end', c.end, 'kind', element_at(array({kinds}), c.k + 1))"
    added = F.expr(f"transform(filter(scored, c -> {compiled(trees, 'c.f')} >= {limits}), c -> {span})")
    return found.select("doc_id", "base", F.sort_array(added).alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of what ``scan`` returns."""
    at = lambda i: lambda s: s["place"] == i
    n = [F.size(F.filter("base", at(i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(BASE)]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "added"))).alias("spans"))
