"""Quality rules: a threshold table compiled into one projection, evaluated by built-in functions only.

Defined cases: null text counts as empty (no words, so the base rule fails it); ratios over zero words or lines are
zero; every input row gives one row, repeated and tied rows included; an empty table gives an empty result. Columns of
the input other than doc_id and text are never read, so clashing names do no harm.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift.llm.common import WORD, let, text_of, words_of

WINDOW = 5
#: The commonest function words of the four languages served.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as are by this from or an was not at "  # English
    "le la les de des du et un une en est que qui dans pour par sur au avec ce ne pas il elle "  # French
    "der die das und in den von zu mit sich auf für ist im dem nicht ein eine als auch es an "  # German
    "el la los las de del y que en un una por con para es se no lo al su como más"  # Spanish
).split()


@dataclass(frozen=True)
class Rule:
    """``measure / per`` must lie in [low, high] (None: unbounded) in texts of ``from_words`` words or more."""

    name: str
    measure: str
    per: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The threshold table. Counts in ``measure`` and ``per`` are those of ``counts``.
RULES = (
    Rule("mean word length", "word_chars", "n_words", 2.0, 15.0),
    Rule("symbols per word", "n_symbols", "n_words", None, 0.15),
    Rule("stop words", "n_stop_words", "n_words", 0.02, None, 30),
    Rule("duplicate lines", "n_dup_lines", "n_lines", None, 0.5),
    Rule("bullet lines", "n_bullet_lines", "n_lines", None, 0.9),
    Rule("ellipsis lines", "n_ellipsis_lines", "n_lines", None, 0.3),
    Rule("words with a letter", "n_letter_words", "n_words", 0.6, None),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_lines", "n_bullet_lines", "n_ellipsis_lines")


def repeat_words(words: Column, size: int = WINDOW) -> Column:
    """Words that lie in a window of ``size`` words found twice or more in the text.

    Hashed windows settle the common case, no repeat at all; only texts with a repeated hash go on to sort the
    windows themselves, so equal hashes of different windows never count.
    """
    starts = F.sequence(F.lit(0), F.size(words) - size)

    def window_text(i: Column) -> Column:
        return F.concat_ws(" ", *[F.get(words, i + k) for k in range(size)])

    def covered(at: Column) -> Column:
        ends = F.aggregate(
            at,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda acc, p: F.struct((p + size).alias("end"), (acc["n"] + p + size - F.greatest(acc["end"], p)).alias("n")),
        )
        return ends["n"].cast("long")

    def exact(hashes: Column) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce((x["h"] == y["h"]) & (window_text(x["i"]) == window_text(y["i"])), F.lit(False))

        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(pairs, lambda s: covered(F.sort_array(F.transform(F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x)), lambda x: x["i"]))))

    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))
    settled = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) <= size, F.lit(0).cast("long")).otherwise(settled)


def counts(text: Column) -> Column:
    """One struct of all counts of a text."""
    stop = [w for w in dict.fromkeys(STOP_WORDS)]

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(stop))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return let(words_of(text), lambda w: let(lines, lambda x: of(w, x)))


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def passes(rule: Rule, c: Column) -> Column:
    ratio = F.when(c[rule.per] > 0, c[rule.measure] / c[rule.per]).otherwise(F.lit(0.0))
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (ratio >= rule.low)
    if rule.high is not None:
        ok = ok & (ratio <= rule.high)
    return ok | (c["n_words"] < rule.from_words) if rule.from_words else ok


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, all counts, base_failed, kept, failed_rules (names, in table order)."""
    c = F.col("c")
    failed = F.array_compact(F.array(*[F.when(~passes(r, c), F.lit(r.name)) for r in rules]))
    judged = docs.select("doc_id", counts(text_of()).alias("c")).select("doc_id", *[c[x].alias(x) for x in COUNTS], base_failed(c).alias("base_failed"), failed.alias("failed_rules"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are. A narrow filter: no shuffle, no join, so equal
    and null ids cannot be confused."""

    def ok(c: Column) -> Column:
        out = ~base_failed(c)
        for r in rules:
            out = out & passes(r, c)
        return out

    return docs.filter(let(counts(text_of()), ok))
