"""Alert texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradesift.config import BAND_LABELS, RULE_LABELS

UNDISCLOSED = "Size undisclosed"
PATTERN_ROWS = 20


def amount(value: Column) -> Column:
    whole = value == F.floor(value)
    shown = F.when(whole, F.format_number(value, 0)).otherwise(F.format_number(value, 1))
    return F.when(value.isNull(), UNDISCLOSED).otherwise(F.concat(F.lit("Rs "), shown, F.lit("cr")))


def general(value: Column) -> Column:
    """Up to six significant digits without trailing zeros, for figures from 1e-4 to under 1e6; larger ones in exponent form."""
    digits = F.floor(F.log10(F.abs(value))) + 1
    places = F.greatest(F.lit(0), 6 - digits).cast("int")
    # format_number rounds the exact binary value half to even, as C's printf does; scaling first would round twice.
    fixed = F.replace(F.call_function("format_number", value, places), F.lit(","), F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(fixed, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.regexp_replace(F.regexp_replace(F.format_string("%.5e", value), r"0+e", "e"), r"\.e", "e")
    return F.when(value == 0, "0").when(F.abs(value) >= 999999.5, exponent).when(F.abs(value) < 1e-4, exponent).otherwise(plain)


def size_shown(value: Column, source: Column, band: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in BAND_LABELS.items() for x in pair])
    known = F.when(source == "computed", F.concat(F.lit("~"), amount(value), F.lit(" (stake x mkt cap)"))).otherwise(amount(value))
    guess = F.when(source == "band", F.concat(F.lit("est. "), F.try_element_at(labels, band)))
    return F.when(value.isNotNull(), known).otherwise(F.coalesce(guess, F.lit(UNDISCLOSED)))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([_*\[\]`])", r"\\$1")


def _or(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def rule_label(rule: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in RULE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, rule), F.lit("other"))


def alert(a: dict[str, Column]) -> Column:
    """Of columns confidence, company, is_update, deal_type, amount_cr, size_source, size_band, one_line, individuals,
    seller, source, url, note."""
    mark = F.when(a["confidence"] == "high", "🔴").otherwise("🟡")
    update = F.coalesce(a["is_update"], F.lit(False))
    company = F.concat(F.when(update, "UPDATE · ").otherwise(""), escape(_or(a["company"], "Unknown company")))
    people = F.coalesce(a["individuals"], F.array().cast("array<string>"))
    same = F.exists(people, lambda p: F.lower(F.trim(p)) == F.lower(F.trim(a["seller"])))
    seller = F.coalesce(a["seller"], F.lit(""))
    paid = (
        F.when(F.size(people) > 0, F.concat(F.lit("💰 "), escape(F.array_join(people, ", ")), F.when((seller != "") & ~same, F.concat(F.lit("  ·  via "), escape(seller))).otherwise("")))
        .when(seller != "", F.concat(F.lit("💰 "), escape(seller), F.lit(" (selling)")))
        .otherwise("No seller named")
    )
    note = F.when(update & (F.coalesce(a["note"], F.lit("")) != ""), F.concat(F.lit("\n_("), escape(a["note"]), F.lit(")_"))).otherwise("")
    return F.concat(
        mark, F.lit(" *"), company, F.lit("* · "), escape(_or(a["deal_type"], "unknown")), F.lit(" · "), size_shown(a["amount_cr"], a["size_source"], a["size_band"]),
        F.lit("\n\n_"), escape(a["one_line"]), F.lit("_"), note, F.lit("\n\n"), paid, F.lit("\n\n["), escape(_or(a["source"], "source")), F.lit("]("), F.coalesce(a["url"], F.lit("")), F.lit(")"),
    )


def confirmed_alert(r: dict[str, Column]) -> Column:
    """Of columns is_update, security_name, deal_type, value_cr, client_name, quantity, price, trade_date, exchange."""
    some = lambda c: F.coalesce(c != 0, F.lit(False))
    sold = F.concat(
        escape(_or(r["client_name"], "Unnamed seller")), F.lit(" sold"),
        F.when(some(r["quantity"]), F.concat(F.lit(" "), F.format_number(F.floor(r["quantity"]), 0), F.lit(" shares"))).otherwise(""),
        F.when(some(r["price"]), F.concat(F.lit(" at Rs "), general(r["price"]))).otherwise(""),
    )
    dated = F.coalesce(r["trade_date"], F.lit(""))
    return F.concat(
        F.lit("🟢 CONFIRMED"), F.when(F.coalesce(r["is_update"], F.lit(False)), " UPDATE").otherwise(""), F.lit(" · *"), escape(_or(r["security_name"], "Unknown company")), F.lit("* · "),
        escape(_or(r["deal_type"], "block deal")), F.lit(" · "), amount(r["value_cr"]), F.lit("\n\n"), sold, F.lit("\n\nSettles T+1"),
        F.when(dated != "", F.concat(F.lit(" · trade date "), escape(dated))).otherwise(""), F.lit("\n"), escape(_or(r["exchange"], "Exchange")),
        F.when(r["deal_type"] == "PIT disclosure", " daily PIT feed").otherwise(" daily deal file"),
    )


def pattern_alert(person: Column, company: Column, total: Column, sales: Column, weeks: Column) -> Column:
    """``sales``: array of struct(trade_date, value_cr), oldest first; the last PATTERN_ROWS are listed, the rest summed."""
    n = F.size(sales)
    hidden = F.greatest(n - PATTERN_ROWS, F.lit(0))
    shown = F.slice(sales, hidden + 1, F.lit(PATTERN_ROWS))
    sum_hidden = F.aggregate(F.slice(sales, F.lit(1), hidden), F.lit(0.0), lambda acc, s: acc + s["value_cr"])
    earlier = F.when(hidden > 0, F.concat(F.lit("… "), hidden.cast("string"), F.lit(" earlier sales totalling "), amount(sum_hidden), F.lit(" …\n"))).otherwise("")
    lines = F.array_join(F.transform(shown, lambda s: F.concat(escape(s["trade_date"]), F.lit("  "), amount(s["value_cr"]))), "\n")
    return F.concat(
        F.lit("🟣 PATTERN · *"), escape(_or(person, "Unnamed individual")), F.lit("* · "), escape(_or(company, "Unknown company")), F.lit(" · "), amount(total), F.lit(" over "),
        n.cast("string"), F.lit(" sales\n\n"), earlier, lines, F.lit("\n\n"), weeks, F.lit(" weeks · no single sale crossed the threshold"),
    )
