"""Queries whose SQL narrows pairs by time or size, against SQL over plainly all pairs."""

from collections import Counter

from pyspark.sql import functions as F

from tradesift import schemas
from tradesift.operators import reports
from tradesift.plans import catalog
from test_catalog import db, plain  # noqa: F401

#: Every pair of a line and a deal.
PAIRS = """
    WITH d AS (SELECT s_suppkey AS id, 'part ' || s_name AS company, s_acctbal AS amount FROM supplier UNION ALL SELECT p_partkey + 1000000, p_name || ' ' || p_brand, p_retailprice * 20 FROM part),
    dt AS (SELECT id, amount, epoch_us(TIMESTAMP '1997-03-01' + to_days((id % 400)::INTEGER)) AS made, list_filter(regexp_split_to_array(lower(company), '[^a-z0-9]+'), lambda w: length(w) > 1) AS t FROM d),
    rt AS (SELECT lineitem, l_extendedprice AS price, epoch_us(l_shipdate) AS seen, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand), '[^a-z0-9]+'), lambda w: length(w) > 1) AS t FROM lineitem JOIN part ON l_partkey = p_partkey),
    m AS (SELECT lineitem, id, made FROM rt JOIN dt ON list_has_any(rt.t, dt.t) AND (
        (seen - made BETWEEN 0 AND 72 * 3600000000 AND (list_has_all(rt.t, dt.t) OR list_has_all(dt.t, rt.t)))
        OR (seen - made BETWEEN 0 AND 168 * 3600000000 AND price > 0 AND amount > 0 AND abs(price - amount) <= 0.05 * greatest(price, amount)))),
    f AS (SELECT lineitem, arg_max(id, (made, id)) AS deal_id FROM m GROUP BY 1)
    SELECT unnest(lineitem), deal_id FROM f
"""


def test_every_line_is_matched(spark, data, db):  # noqa: F811
    want = db.execute(PAIRS).fetchall()
    got = catalog.QUERIES["open_deal_matches"](spark, data).collect()
    assert Counter(tuple(map(plain, r)) for r in got) == Counter(tuple(map(plain, r)) for r in want)
    assert {r.l_linenumber for r in got} == set(range(1, 8))


def test_every_pair_of_lines_is_compared(spark, data, db):  # noqa: F811
    """Token sets as the members query names them, each pair by Python sets."""
    rows = [r.tokens for r in catalog.QUERIES["title_near_dup_members"](spark, data).collect()]
    assert len(rows) == db.execute("SELECT sum(len(string_split(coalesce(text, ''), chr(10)))) FROM documents").fetchone()[0]
    sets = sorted({(frozenset(t.split(" ")), t) for t in rows if t}, key=lambda s: len(s[0]))
    want = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if 0.85 * len(b) > len(a):
                break
            n = len(a & b)
            if n / (len(a) + len(b) - n) > 0.85:
                want.add(frozenset((x, y)))
    got = [frozenset((r.a, r.b)) for r in catalog.QUERIES["title_near_dup_pairs"](spark, data).collect()]
    assert want and len(got) == len(want) and set(got) == want
    links = Counter(t for pair in want for t in pair)
    assert {r.tokens: r.links for r in catalog.QUERIES["title_near_dup"](spark, data).collect()} == {t: links[t] for _, t in sets}


def test_feedback_without_a_deal_stays(spark):
    feedback = spark.sql("SELECT 1L AS id, 7L AS deal_id, 'good' AS verdict, timestamp'2024-01-29' AS created_at UNION ALL SELECT 2L, 8L, 'noise', timestamp'2024-01-29' UNION ALL SELECT 3L, NULL, 'noise', timestamp'2024-01-29'")
    deals = schemas.conform(spark.sql("SELECT 7L AS id, 'Acme' AS company"), schemas.STATE["deals"])
    got = reports.feedback_rows(feedback, deals, F.lit("2024-01-30").cast("timestamp")).select("id", "company").collect()
    assert [tuple(r) for r in got] == [(3, None), (2, None), (1, "Acme")]
