"""Structured trades: parsing, selection, and split-up sales found over a rolling window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradesift.config import DEFAULT, Config
from tradesift.functions import dates, names
from tradesift.operators import classify, filters


def selected_trades(trades: DataFrame, call=None) -> DataFrame:
    """Sales by individuals and promoter vehicles: sell side with a value; ambiguous names go to the model once each."""
    sells = trades.filter(filters.is_sell(F.col("buy_sell"), F.col("value_cr"))).withColumn("seller_class", names.seller_class(F.col("client_name")))
    judged = classify.resolve_sellers(sells, "client_name", call or classify.RuleClassifier().sellers)
    return judged.filter((F.col("seller_class") == "individual") | ((F.col("seller_class") == "ambiguous") & (F.col("seller_verdict") != "institution")))


def selected_disclosures(rows: DataFrame) -> DataFrame:
    return rows.filter(filters.is_disposal(F.col("trans_type")) & filters.pit_category(F.col("category")) & (F.col("value_cr") > 0))


def trade_id() -> Column:
    return F.concat_ws(":", "exchange", "deal_type", "trade_date", "symbol", "client_name", "buy_sell", F.col("quantity").cast("string"))


def disclosure_id(with_value: bool = False) -> Column:
    return F.concat_ws(":", F.lit("PIT"), "trade_date", "symbol", "person_name", "trans_type", *([F.col("value_cr").cast("string")] if with_value else []))


def patterns(sales: DataFrame, alerts: DataFrame, as_of: Column, time_col: str = "created_at", config: Config = DEFAULT) -> DataFrame:
    """(person, company) pairs whose sales of the window add up, none of them dominating, and that are due for an alert:
    never alerted, or the total has doubled, or the last alert is old."""
    recent = sales.filter((F.col("person_key") != "") & (F.col("company_key") != "") & (F.col(time_col) >= as_of - F.make_dt_interval(F.lit(config.pattern_days))))
    parsed = recent.withColumn("_d", dates.parse_trade_date(F.col("trade_date")))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_d").isNull().alias("late"), F.col("_d").alias("day"), "created_at", "id", "trade_date", "value_cr", "person_name", "company")))
    summed = parsed.groupBy("person_key", "company_key").agg(F.round(F.sum("value_cr"), 2).alias("total_cr"), F.count("*").alias("n"), F.max("value_cr").alias("largest"), ordered.alias("sales"))
    fit = summed.filter((F.col("total_cr") >= config.pattern_min) & (F.col("n") >= config.pattern_min_sales) & (F.col("largest") <= config.pattern_max_share * F.col("total_cr")))
    last = alerts.groupBy("person_key", "company_key").agg(F.max_by("total_cr", F.struct("alerted_at", "id")).alias("last_total"), F.max("alerted_at").alias("last_at"))
    due = F.col("last_at").isNull() | (F.col("total_cr") >= config.realert_multiple * F.col("last_total")) | (F.col("last_at") <= as_of - F.make_dt_interval(F.lit(config.realert_days)))
    return fit.join(last, ["person_key", "company_key"], "left").filter(due).select(
        "person_key", "company_key", F.col("sales")[0]["person_name"].alias("person_name"), F.col("sales")[0]["company"].alias("company"), "total_cr", "n", "largest",
        dates.span_weeks(F.transform("sales", lambda s: s["day"])).alias("weeks"), F.transform("sales", lambda s: F.struct(s["trade_date"].alias("trade_date"), s["value_cr"].alias("value_cr"))).alias("sales"),
    )


def rolling(sales: DataFrame, keys: list[str], at: str, value: str, days: int, least: float, min_n: int, max_share: float) -> DataFrame:
    """Every sale at which the trailing window qualifies: one range window, no self-join."""
    w = Window.partitionBy(*keys).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-days * 86400, 0)
    out = sales.withColumns({"total": F.sum(value).over(w), "n": F.count("*").over(w), "largest": F.max(value).over(w)})
    return out.filter((F.col("total") >= least) & (F.col("n") >= min_n) & (F.col("largest") <= max_share * F.col("total")))


def realerts(found: DataFrame, keys: list[str], at: str, total: str, order: str, config: Config = DEFAULT) -> DataFrame:
    """Of the times at which a key qualifies (``found``) those at which an alert is due, with ``prior``, the total of the
    alert before (null at a key's first): the total has grown by the multiple since the last alert, or that is long ago.

    Rows of a key stream past in order, in one task but never all in memory: from an alert on the next one is searched, so
    the work in between is a binary search and a comparison. Rows without time or total never alert."""
    ready = found.filter(F.col(at).isNotNull() & F.col(total).isNotNull()).withColumn("_at", F.unix_micros(F.col(at).cast("timestamp")))
    ordered = ready.repartition(*keys).sortWithinPartitions(*keys, "_at", order)
    later, times = config.realert_days * 86_400_000_000, config.realert_multiple

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, since = None, None, None  # of the row before, and of its key's last alert
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [np.array(batch.column(k).to_pylist(), object) for k in keys]
            when, totals = batch.column("_at").to_numpy(), batch.column(total).to_numpy(zero_copy_only=False)
            new = np.zeros(n, bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = key is None or key != tuple(c[0] for c in columns)
            due, prior = np.zeros(n, bool), [None] * n
            starts = np.unique(np.append(0, np.flatnonzero(new)))
            for a, b in zip(starts, np.append(starts[1:], n)):
                if new[a]:
                    last = since = None
                while a < b:
                    if last is not None:
                        b_old = a + int(np.searchsorted(when[a:b], since + later))
                        grown = np.flatnonzero(totals[a:b_old] >= times * last)
                        a = a + int(grown[0]) if len(grown) else b_old
                        if a == b:
                            break
                    due[a], prior[a] = True, last
                    last, since = float(totals[a]), int(when[a])
                    a += 1
            key = tuple(c[-1] for c in columns)
            out = batch.append_column("prior", pa.array(prior, pa.float64()))
            yield out.filter(pa.array(due)).drop_columns(["_at"])

    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", prior double")


def sales_of_deal(deals: DataFrame, split: bool = False) -> DataFrame:
    """One row for each named individual of a deal: the full amount each, or an equal part of it."""
    amount = F.col("amount_cr") / F.size("individuals") if split else F.col("amount_cr")
    return deals.filter((F.size("individuals") > 0) & F.col("amount_cr").isNotNull()).withColumn("value_cr", amount).withColumn("person_name", F.explode("individuals")).withColumn("company_key", names.deal_key(F.col("company")))
