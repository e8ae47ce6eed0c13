"""Digest, attribution, audit and feedback reports: DataFrames in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradesift.config import DEFAULT, VERDICTS, Config
from tradesift.functions import format
from tradesift.operators.dedup import first_of

FUNNEL = ("fetched", "already_seen", "structural_dropped", "title_deduped", "bse_mcap_gated", "pre_api_gated", "reached_stage1", "reached_stage2", "alerted")


def within(df: DataFrame, column: str, as_of: Column, days: int = 0, hours: int = 0) -> DataFrame:
    return df.filter(F.col(column) >= as_of - F.make_dt_interval(F.lit(days), F.lit(hours)))


def suppressed_by_rule(suppressed: DataFrame) -> DataFrame:
    return suppressed.groupBy("rule").agg(F.count("*").alias("n")).withColumn("label", format.rule_label(F.col("rule"))).orderBy(F.desc("n"), "rule")


def largest_suppressed(suppressed: DataFrame) -> DataFrame:
    return suppressed.filter("amount_cr IS NOT NULL").orderBy(F.desc("amount_cr"), "id").limit(1)


def funnel_totals(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in FUNNEL])


def digest(spark: SparkSession, suppressed: DataFrame, deals: DataFrame, alerts: DataFrame, runs: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """section, name, n, amount: all sections of the day, or nothing if nothing was suppressed."""
    h = config.digest_hours
    s = within(suppressed, "created_at", as_of, hours=h)
    row = lambda df, section, name, n, amount=F.lit(None): df.select(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("n"), amount.cast("double").alias("amount"))
    rules = row(suppressed_by_rule(s), "suppressed", F.col("label"), F.col("n"))
    largest = row(largest_suppressed(s), "largest", F.col("title"), F.lit(1), F.col("amount_cr"))
    confirmed = row(within(deals, "updated_at", as_of, hours=h).filter("confirmed").agg(F.count("*").alias("n")), "confirmed", F.lit("deals"), F.col("n"))
    pattern = row(within(alerts, "alerted_at", as_of, hours=h).agg(F.count("*").alias("n")), "pattern", F.lit("alerts"), F.col("n"))
    totals = funnel_totals(within(runs, "created_at", as_of, hours=h)).select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("long").alias("v")) for c in ("runs", *FUNNEL)])).alias("x"))
    funnel = row(totals, "funnel", F.col("x.c"), F.col("x.v"))
    everything = rules.unionByName(largest).unionByName(confirmed).unionByName(pattern).unionByName(funnel)
    any_row = s.select(F.lit(True).alias("_any")).limit(1)
    return everything.withColumn("_any", F.lit(True)).join(any_row, "_any", "left_semi").drop("_any")


def feedback_rows(feedback: DataFrame, deals: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    d = deals.select(F.col("id").alias("deal_id"), "company", "source", "deal_type", "size_source", "confidence", "one_line")
    return within(feedback, "created_at", as_of, days=config.feedback_days).join(d, "deal_id", "left").orderBy(F.desc("created_at"), F.desc("id"))


def verdict_counts(spark: SparkSession, rows: DataFrame) -> DataFrame:
    domain = spark.createDataFrame([(i, v) for i, v in enumerate(VERDICTS)], "place int, verdict string")
    counted = rows.groupBy("verdict").agg(F.count("*").alias("n"))
    return domain.join(F.broadcast(counted.filter(F.col("verdict").isin(*VERDICTS))), "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")


def breakdowns(rows: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n of several fields in one pass by grouping sets."""
    named = rows.select(*[F.coalesce(F.nullif(F.col(f), F.lit("")), F.lit("unknown")).alias(f) for f in fields])
    sets = named.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bit = {f: (1 << len(fields)) - 1 - (1 << (len(fields) - 1 - i)) for i, f in enumerate(fields)}
    field = F.coalesce(*[F.when(F.col("g") == b, F.lit(f)) for f, b in bit.items()])
    value = F.coalesce(*[F.when(F.col("g") == b, F.col(f)) for f, b in bit.items()])
    return sets.select(field.alias("field"), value.alias("value"), "n").orderBy("field", F.desc("n"), "value")


def top_per_group(rows: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first k of each group with its size and what is left out."""
    from pyspark.sql import Window

    w = Window.partitionBy(group)
    return rows.withColumns({"place": F.row_number().over(w.orderBy(*order)), "group_size": F.count("*").over(w)}).filter(F.col("place") <= k).withColumn("hidden", F.greatest(F.col("group_size") - k, F.lit(0)))


def shadow_rows(prefilter: DataFrame, dedup: DataFrame) -> DataFrame:
    """Both logs in one shape."""
    logged = dedup.select(F.lit("title_dedup").alias("filter"), "title", "url", F.concat(F.lit("matches: "), F.col("matched_title"), F.lit(" ("), F.format_number("similarity", 2), F.lit(")")).alias("reason"), "created_at")
    return prefilter.select("filter", "title", "url", "reason", "created_at").unionByName(logged)


def query_stats(item_queries: DataFrame, members: DataFrame, items: DataFrame, deals: DataFrame, as_of: Column, config: Config = DEFAULT) -> DataFrame:
    """query, produced, first_surfaced: rows each query brought, and deals whose earliest traceable report it brought."""
    days = config.query_stats_days
    iq = within(item_queries, "created_at", as_of, days=days)
    produced = iq.groupBy("query").agg(F.count("*").alias("produced"))
    fresh = within(deals, "created_at", as_of, days=days).select(F.col("id").alias("deal_id"))
    traced = members.filter("url <> ''").join(fresh, "deal_id", "left_semi").join(items.select(F.col("id").alias("item_id"), "url"), "url").join(item_queries.select("item_id").distinct(), "item_id", "left_semi")
    first = first_of(traced, ["deal_id"], F.col("attached_at"), F.col("id"), F.col("item_id"))
    surfaced = first.join(item_queries.select("item_id", "query").distinct(), "item_id").groupBy("query").agg(F.count("*").alias("first_surfaced"))
    return produced.join(surfaced, "query", "full_outer").select("query", F.coalesce("produced", F.lit(0)).alias("produced"), F.coalesce("first_surfaced", F.lit(0)).alias("first_surfaced"))


def configured_query_stats(spark: SparkSession, queries: tuple[str, ...], stats: DataFrame) -> DataFrame:
    """All configured queries in their order, with zeros."""
    domain = spark.createDataFrame(list(enumerate(queries)), "place int, query string")
    return domain.join(stats, "query", "left").select("query", F.coalesce("produced", F.lit(0)).alias("produced"), F.coalesce("first_surfaced", F.lit(0)).alias("first_surfaced"), "place").orderBy("place").drop("place")


def merged_clusters(deals: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """Deals of ``least`` reports or more with their titles in order."""
    grouped = members.groupBy("deal_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("attached_at", "id", "title"))), lambda s: s["title"]).alias("titles"))
    return deals.join(grouped.filter(F.col("n") >= least), deals["id"] == F.col("deal_id")).select("deal_id", "company", "n", "titles").orderBy(F.desc("n"), "deal_id")


def size_mix(deals: DataFrame) -> DataFrame:
    return deals.groupBy("size_source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size_source")
