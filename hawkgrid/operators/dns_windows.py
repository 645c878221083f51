"""DNS behaviour per source: bursts of distinct names and high NXDOMAIN rates.

Counters live in sessions that end after a silence; queries, responses and NXDOMAIN
responses have separate sessions, and the response counters are read as of each query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.functions import scan
from hawkgrid.functions.net import normalise_ip
from hawkgrid.functions.parse import safe_int
from hawkgrid.functions.sessions import time_bin
from hawkgrid.operators.rules import DNS_BURST, DNS_NXDOMAIN, detection, fire
from hawkgrid.session import durable

SECOND = 1_000_000
_SRC = ["source_ip"]


def _query_sessions(bins: DataFrame, gap_us: int) -> DataFrame:
    """Number the query sessions; bins without queries keep the running number."""
    w = Window.partitionBy(*_SRC).orderBy("bin")
    before = F.last("query_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("query_first").isNotNull() & F.coalesce(F.col("query_first") - before > gap_us, F.lit(True))
    return bins.withColumn("_opens", opens.cast("bigint")).withColumn(
        "session", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_opens", "query_first", "query_last")


def _counter_bins(bins: DataFrame, n: str, gap_us: int) -> DataFrame:
    """Per bin: the counter carried into it, and the counter as it stood before it."""
    w = Window.partitionBy(*_SRC).orderBy("bin")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first, last = f"{n}_first", f"{n}_last"
    out = bins.withColumns({
        f"{n}_prev": F.last(last, ignorenulls=True).over(past),
        f"{n}_cum": F.coalesce(F.sum(n).over(past), F.lit(0)),
    })
    opens = F.col(first).isNotNull() & F.coalesce(F.col(first) - F.col(f"{n}_prev") > gap_us, F.lit(True))
    out = out.withColumn("_open", F.when(opens, F.col(f"{n}_cum")))
    return out.withColumns({
        f"{n}_carry": F.col(f"{n}_cum") - F.coalesce(F.last("_open", ignorenulls=True).over(upto), F.lit(0)),
        f"{n}_before": F.col(f"{n}_cum") - F.coalesce(F.last("_open", ignorenulls=True).over(past), F.lit(0)),
    }).drop("_open", f"{n}_cum", first, last, n)


def _live_count(n: str, gap_us: int):
    """The counter's value at a query: in-bin count plus carry, or what is still alive."""
    alive = F.col("t_us") - F.col(f"{n}_prev") <= gap_us
    return (
        F.when(F.col(f"_{n}_run") > 0, F.col(f"{n}_carry") + F.col(f"_{n}_run"))
        .when(F.coalesce(alive, F.lit(False)), F.col(f"{n}_before"))
        .otherwise(F.lit(0)).cast("bigint")
    )


def dns_windows(
    dns: DataFrame,
    window_s: float = 60.0,
    distinct_min: int = 40,
    responses_min: int = 8,
    nxdomain_rate: float = 0.5,
    hot_rows: int = scan.HOT_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Session statistics and burst reason at every DNS query.

    Input: ``orig_h, t_us, seq, query, rcode, event_type`` with types ``dns`` and
    ``dns_response``; at equal (t_us, seq) the query comes before its response.
    """
    gap = int(window_s * SECOND)
    query = F.trim(F.col("query"))
    is_query = F.col("event_type") == "dns"
    rows = dns.select(
        normalise_ip("orig_h").alias("source_ip"), "t_us", "seq",
        F.when(is_query, query).alias("query"), (~is_query).cast("int").alias("kind"),
        (~is_query).cast("bigint").alias("resp"),
        (~is_query & (safe_int(F.col("rcode")) == 3)).cast("bigint").alias("nx"), *keep,
    ).where(
        F.col("source_ip").isNotNull()
        & F.when(F.col("kind") == 0, F.length("query") > 0).otherwise(dns["event_type"] == "dns_response")
    ).withColumn("bin", time_bin("t_us", gap))

    t = F.col("t_us")
    first_last = {
        name: (F.min(F.when(cond, t)).alias(f"{name}_first"), F.max(F.when(cond, t)).alias(f"{name}_last"))
        for name, cond in {"query": F.col("kind") == 0, "resp": F.col("resp") == 1, "nx": F.col("nx") == 1}.items()
    }
    bins = rows.groupBy(*_SRC, "bin").agg(
        F.count("*").alias("_n"), F.sum("resp").alias("resp"), F.sum("nx").alias("nx"),
        *first_last["query"], *first_last["resp"], *first_last["nx"])
    bins = _counter_bins(_counter_bins(_query_sessions(bins, gap), "resp", gap), "nx", gap)
    # One row per (source, bin); joined twice below.
    bins = durable(bins)

    keys = [*_SRC, "bin"]
    queries = rows.where("kind = 0").select(*keys, "t_us", "seq", "query")
    firsts = queries.join(bins.select(*keys, "session"), keys).groupBy(*_SRC, "session", "query").agg(
        F.min(F.struct("t_us", "seq")).alias("at"))
    # The first time a name is asked in a session becomes a marker row just before its
    # query, so the number of distinct names is one more running count.
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    marks = firsts.select(*_SRC, F.col("at.t_us").alias("t_us"), F.col("at.seq").alias("seq")).withColumn(
        "bin", time_bin("t_us", gap))
    earlier = Window.partitionBy(*_SRC, "session").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    named = marks.groupBy(*keys).agg(F.count("*").alias("_names"))
    carried = bins.join(named, keys, "left").withColumn("name_carry", F.coalesce(F.sum("_names").over(earlier), zero))

    hot = scan.hot_from_counts(bins, keys, hot_rows)
    events = rows.withColumn("first", zero).unionByName(
        marks.withColumns({"kind": F.lit(-1), "resp": zero, "nx": zero, "first": one}), allowMissingColumns=True)
    runs = scan.running_sums(events, keys, ["t_us", "seq", "kind"], {
        "_resp_run": F.col("resp"), "_nx_run": F.col("nx"), "_name_run": F.col("first")}, hot)
    distinct = F.col("name_carry") + F.col("_name_run")
    at_query = (
        runs.where("kind = 0").drop("resp", "nx", "kind", "first")
        .join(carried.drop("_n", "_names", "session"), keys)
        .select(
            *_SRC, "t_us", "seq", "query", *keep, distinct.cast("bigint").alias("distinct_domains"),
            _live_count("resp", gap).alias("total_responses"), _live_count("nx", gap).alias("nxdomain_responses"),
        )
    )
    rate = F.when(F.col("total_responses") > 0, F.col("nxdomain_responses") / F.col("total_responses")).otherwise(0.0)
    reason = (
        F.when(F.col("distinct_domains") >= distinct_min, "distinct_domain_burst")
        .when((F.col("total_responses") >= responses_min) & (F.col("nxdomain_rate") >= nxdomain_rate),
              "high_nxdomain_rate")
    )
    return at_query.withColumn("nxdomain_rate", rate).withColumn("reason", reason)


def dns_window_detections(windows: DataFrame) -> DataFrame:
    """Burst detections: distinct names are graded high, NXDOMAIN rates medium."""
    evidence = F.to_json(F.struct(
        F.col("query").alias("domain"), "reason", "distinct_domains", "nxdomain_rate", "total_responses"))
    return fire(windows, [
        (F.col("reason") == "distinct_domain_burst", detection(DNS_BURST, evidence)),
        (F.col("reason") == "high_nxdomain_rate", detection(DNS_NXDOMAIN, evidence)),
    ])
