"""Batched external models: fixed batches, answers aligned by place, failures as a route of their own.

A classifier is any object with ``stage1``, ``stage2`` and ``sellers``, each from a list of strings to the model's JSON
text. ``ModelClassifier`` makes one of any function from a message to a reply, and tells the model its contract.
``RuleClassifier`` is a deterministic stand-in without a network."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.config import DEFAULT, Config
from tradesift.functions import text
from tradesift.operators import dedup, numbering


#: What a model is told before the numbered items of a batch, and the form of its reply.
CONTRACT = {
    "stage1": "For each numbered news item say whether it is certainly no share sale by an individual or a promoter family of an Indian company. "
    "Classes of such items: 1 debt only, 2 insolvency, 3 state-owned seller, 4 sale of a subsidiary, 5 inside one group, 6 no Indian individual gains, "
    "7 early funding round, 8 stated size under the threshold, 9 no transaction. "
    "Not of these classes, so not certain: a listing in which holders sell, once it is announced, and a holding company that few people or one family own. "
    'Reply with a JSON list, one object for each item and in its order: {"n": number, "neg": true or false, "r": class or null}.',
    "stage2": "For each numbered news item decide whether an individual or a promoter family receives money for shares, and give its facts as the text states them; leave null what it does not state. "
    'Reply with a JSON list, one object for each item and in its order: {"n", "qualify", "drop_reason", "company", "deal_type", "amount_cr" (crore rupees), "amount_raw" (as quoted), '
    '"individuals" (list), "seller", "confidence" (high, medium, low), "one_line", "size_band" (UNDER_100, 100_TO_500, 500_TO_2000, OVER_2000, UNKNOWN), "size_basis"}.',
    "sellers": "For each numbered name of a seller say whether it is a promoter or family vehicle, an institution, or unclear. "
    'Reply with a JSON list, one object for each name and in its order: {"n", "name", "verdict": "promoter", "institution" or "unclear"}.',
}


def numbered_text(task: str, prompts: list[str]) -> str:
    """The whole message to a model: the contract, then the items by number."""
    return CONTRACT[task] + "\n\n" + "\n\n".join(f"[{n}] {p}" for n, p in enumerate(prompts, 1))


class Classifier(Protocol):
    def stage1(self, prompts: list[str]) -> str: ...

    def stage2(self, prompts: list[str]) -> str: ...

    def sellers(self, names: list[str]) -> str: ...


class ModelClassifier:
    """``complete`` takes a whole message, contract and numbered items, and returns the model's reply; it may raise. It runs
    on executors, a batch at a time, so it must be picklable: it should open its connection when it is called."""

    def __init__(self, complete: Callable[[str], str]):
        self.complete = complete

    def stage1(self, prompts: list[str]) -> str:
        return self.complete(numbered_text("stage1", prompts))

    def stage2(self, prompts: list[str]) -> str:
        return self.complete(numbered_text("stage2", prompts))

    def sellers(self, names: list[str]) -> str:
        return self.complete(numbered_text("sellers", names))


class RuleClassifier:
    """Keyword rules for the negative classes and first-guess fields, so that pipelines run offline."""

    NEGATIVE = (
        (1, r"\b(debentures?|ncds?|bonds?|term loan)\b"), (2, r"\b(nclt|ibc|insolvency|resolution plan)\b"), (3, r"\b(psu|disinvestment|government stake)\b"),
        (4, r"\bsubsidiary\b.*\bsale\b"), (5, r"\b(inter se|intra-group)\b"), (7, r"\b(seed|pre-seed|series a)\b"), (9, r"\b(quarterly results|award|appoints ceo)\b"),
    )

    def stage1(self, prompts: list[str]) -> str:
        out = []
        for n, p in enumerate(prompts, 1):
            rule = next((r for r, rx in self.NEGATIVE if re.search(rx, p, re.I)), None)
            out.append({"n": n, "neg": rule is not None, "r": rule})
        return json.dumps(out)

    def stage2(self, prompts: list[str]) -> str:
        out = []
        for n, p in enumerate(prompts, 1):
            figure = re.search(r"([0-9][0-9,.]*)\s*-?(?:crore|cr)\b", p, re.I)
            company = re.match(r"\s*(.*?)\s+(?:promoter|founder|sells?|to sell|stake|block)\b", p, re.I)
            out.append({"n": n, "qualify": True, "company": company[1] if company else p[:60], "amount_cr": float(figure[1].replace(",", "").rstrip(".")) if figure else None, "amount_raw": figure[0] if figure else None, "deal_type": "promoter sale", "one_line": p[:80]})
        return json.dumps(out)

    def sellers(self, names: list[str]) -> str:
        return json.dumps([{"n": n, "name": x, "verdict": "promoter" if re.search(r"family|trust", x, re.I) else "institution" if re.search(r"global|international", x, re.I) else "unclear"} for n, x in enumerate(names, 1)])


def prompt(title: Column, description: Column, config: Config = DEFAULT) -> Column:
    return F.concat_ws("\n", F.coalesce(title, F.lit("")), F.left(F.coalesce(description, F.lit("")), F.lit(config.description_chars)))


def in_batches(items: DataFrame, order: list[str], size: int) -> DataFrame:
    """With batch and place, by a total order, numbered over ranges: no task holds all items."""
    placed = numbering.numbered(items, [F.col(c) for c in order], dedup.stored, "_n")
    return placed.withColumn("batch", F.floor(F.col("_n") / size)).withColumn("place", (F.col("_n") % size).cast("int")).drop("_n")


def parse_array(reply: str, expected: int) -> list[dict]:
    """The JSON list in a reply, from its first bracket to its last; padded with empty objects to ``expected``."""
    a, b = reply.find("["), reply.rfind("]")
    if a < 0 or b < a:
        raise ValueError("no list in the reply")
    got = json.loads(reply[a : b + 1])
    if not isinstance(got, list):
        raise ValueError("not a list")
    return [x if isinstance(x, dict) else {} for x in got[:expected]] + [{}] * (expected - len(got))


def failure(error: Exception) -> str:
    """What a warning says of a failed batch."""
    return f"{type(error).__name__}: {error}"[:180]


def ask(items: DataFrame, call: Callable[[list[str]], str], order: list[str], config: Config = DEFAULT) -> DataFrame:
    """``items`` (with prompt) with reply (JSON of one object, or null), failed and reason (of the failure). A failing batch
    fails all its items."""
    dealt = in_batches(items, order, config.batch_size)
    schema = items.schema.simpleString()[len("struct<") : -1] + ",batch:bigint,place:int,reply:string,failed:boolean,reason:string"

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            answers = parse_array(call(rows["prompt"].tolist()), len(rows))
            return rows.assign(reply=[json.dumps(a) for a in answers], failed=False, reason=None)
        except Exception as e:
            return rows.assign(reply=None, failed=True, reason=failure(e))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames sorted by batch and place; a batch may run over two of them."""
        held = None
        for frame in frames:
            held = frame if held is None or not len(held) else pd.concat([held, frame], ignore_index=True)
            whole = held["batch"] != held["batch"].iloc[-1] if len(held) else []
            for _, rows in held[whole].groupby("batch", sort=False) if len(held) else []:
                yield answer(rows)
            held = held[~whole] if len(held) else held
        if held is not None and len(held):
            yield answer(held)

    return dealt.repartition("batch").sortWithinPartitions("batch", "place").mapInPandas(run, schema)


def stage1_verdict(reply: Column) -> Column:
    """struct(neg, rule): missing means not negative; a rule that is no whole number is null."""
    got = F.from_json(F.concat(F.lit("["), reply, F.lit("]")), schemas.STAGE1)[0]
    return F.struct(F.coalesce(got["neg"], F.lit(False)).alias("neg"), got["r"].try_cast("int").alias("rule"))


def stage2_result(reply: Column) -> Column:
    """All fields with their defaults, the amount repaired against its own quotation."""
    got = F.from_json(F.concat(F.lit("["), reply, F.lit("]")), schemas.STAGE2)[0]
    said = lambda f, default: F.coalesce(F.nullif(got[f], F.lit("")), F.lit(default)).alias(f)
    fixed = text.reconcile(got["amount_cr"], got["amount_raw"])
    return F.struct(
        F.coalesce(got["qualify"], F.lit(False)).alias("qualify"), got["drop_reason"].alias("drop_reason"), F.coalesce(got["company"], F.lit("")).alias("company"), said("deal_type", "unknown"),
        fixed["amount"].alias("amount_cr"), fixed["fixed"].alias("amount_fixed"), got["amount_raw"].alias("amount_raw"), F.coalesce(got["individuals"], F.array().cast("array<string>")).alias("individuals"),
        F.nullif(got["seller"], F.lit("")).alias("seller"), said("confidence", "medium"), F.coalesce(got["one_line"], F.lit("")).alias("one_line"), said("size_band", "UNKNOWN"), said("size_basis", "no information"),
    )


def route_stage1(items: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``items`` with failed, verdict, title, description: adds route (retry, suppress, pass) and rule. A small-deal verdict
    against a stated figure that reaches the threshold is overruled."""
    rescued = (F.col("verdict.rule") == 8) & (F.coalesce(text.stated_max(F.col("title"), F.col("description"), config=config), F.lit(0.0)) >= config.threshold)
    negative = F.col("verdict.neg") & ~F.coalesce(rescued, F.lit(False))
    rule = F.concat(F.lit("Rule "), F.coalesce(F.col("verdict.rule").cast("string"), F.lit("?")))
    return items.withColumn("route", F.when(F.col("failed"), "retry").when(negative, "suppress").otherwise("pass")).withColumn("rule", F.when(F.col("route") == "suppress", rule))


def route_stage2(items: DataFrame) -> DataFrame:
    """``items`` with failed and result: adds route and rule."""
    return items.withColumn("route", F.when(F.col("failed"), "retry").when(~F.col("result.qualify"), "suppress").otherwise("pass")).withColumn("rule", F.when(F.col("route") == "suppress", "Rule P"))


def resolve_sellers(rows: DataFrame, name: str, call: Callable[[list[str]], str], config: Config = DEFAULT) -> DataFrame:
    """With seller_verdict for ambiguous names: each distinct name is asked once, ``config.batch_size`` at a time; names
    that get no verdict, and those of a failing batch, are unclear."""
    unclear = F.lit("unclear")
    asked = rows.filter("seller_class = 'ambiguous'").select(F.col(name).alias("prompt")).filter("prompt IS NOT NULL").distinct()
    told = ask(asked, call, ["prompt"], config)
    verdict = F.from_json(F.concat(F.lit("["), F.col("reply"), F.lit("]")), "array<struct<verdict:string>>")[0]["verdict"]
    told = told.select(F.col("prompt").alias(name), F.coalesce(F.nullif(verdict, F.lit("")), unclear).alias("seller_verdict"))
    return rows.join(told, name, "left").withColumn("seller_verdict", F.coalesce("seller_verdict", unclear))
