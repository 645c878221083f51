"""Views over the driver's fixture tables in the shape of network data.

The fixture tables hold no network logs. Each column is a fixed expression of an
``events`` or ``lineitem`` row, so the views grow with the tables. ``compress``
divides time, because the fixture events are days apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str, compress: int) -> DataFrame:
    t_us = F.expr(f"(unix_micros(cast(ts as timestamp)) - {EPOCH_US}) div {compress}")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), t_us.alias("t_us"), "user_id", F.col("event_type").alias("kind"), "value",
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 20 + 1).cast("string")).alias("orig_h"),
        F.concat(F.lit("45.3.0."), (F.col("user_id") % 3 + 1).cast("string")).alias("resp_h"),
        (F.col("user_id") % 3).alias("tenant_id"),
    )


def conn_view(spark: SparkSession, sf_dir: str, compress: int = 60) -> DataFrame:
    e = _events(spark, sf_dir, compress)
    k, kind, value = F.col("k"), F.col("kind"), F.col("value")
    floor = lambda c: F.floor(c).cast("bigint")
    return e.select(
        "seq", "t_us", "user_id", "kind", "tenant_id", "orig_h", "resp_h",
        F.when(k % 5 == 0, 443).when(k % 5 == 1, 53).otherwise(k + 1024).cast("int").alias("resp_p"),
        F.when(kind == "error", "REJ").when(kind == "view", "S0").otherwise("SF").alias("conn_state"),
        F.when(kind == "error", k * 150).when(kind == "view", k % 8).otherwise(k + 5).alias("orig_pkts"),
        F.when(kind == "purchase", floor(value * 60000)).when(kind == "click", k + 50)
        .otherwise(floor(value * 10)).alias("orig_bytes"),
        F.when(kind == "purchase", k * 150).when(kind == "click", (k * 7) % 110 + 50)
        .otherwise(k * 500).alias("resp_bytes"),
        (value / 10).alias("duration"),
        F.when(k == 13, "t13d000000_rare_fingerprint").otherwise("t13d1516h2_8daaf6152771_02713d6af862").alias("ja4"),
        F.lit("conn").alias("event_type"),
    )


def dns_view(spark: SparkSession, sf_dir: str, compress: int = 60) -> DataFrame:
    """One query and one response row per event; the query comes first."""
    e = _events(spark, sf_dir, compress)
    k = F.col("k")
    by_event, by_user = F.md5(F.col("seq").cast("string")), F.md5(F.col("user_id").cast("string"))
    query = (
        F.when(k % 11 == 0, F.concat(by_event, by_user, F.lit(".tunnel.example.com")))
        .when(k % 3 == 0, F.concat(
            F.substring(by_event, 1, 12),
            F.translate(F.substring(by_event, 13, 12), "0123456789abcdef", "ghijklmnopqrstuv"), F.lit(".com")))
        .when(k % 7 == 0, F.concat(F.substring(by_event, 1, 20), F.lit(".cloudfront.net")))
        .otherwise(F.concat(F.lit("www"), k.cast("string"), F.lit(".example.com")))
    )
    base = e.select(
        "seq", "t_us", "user_id", "tenant_id", "orig_h", "resp_h", query.alias("query"),
        F.when(k % 11 == 0, "TXT").otherwise("A").alias("qtype_name"),
        F.when(k % 5 < 3, 3).otherwise(0).cast("int").alias("rcode"),
    )
    return base.withColumn("event_type", F.explode(F.array(F.lit("dns"), F.lit("dns_response"))))


def packets_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets from line items; day-granular times give deliberate ties."""
    supplier = F.concat(F.lit("10.1.0."), (F.col("l_suppkey") % 50 + 1).cast("string"))
    part = F.concat(F.lit("10.1.0."), (F.col("l_partkey") % 50 + 1).cast("string"))
    query = F.concat(F.lit("host"), (F.col("l_partkey") % 100).cast("string"), F.lit(".example.com."))
    is_dns = F.col("l_linenumber") == 1
    order = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(
        F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("t_us"),
        (order * 8 + F.col("l_linenumber")).alias("seq"),
        supplier.alias("src_ip"), F.when(is_dns, 53).otherwise(F.col("l_linenumber") + 1000).alias("src_port"),
        part.alias("dst_ip"), F.when(is_dns, 53).otherwise(F.col("l_linenumber") % 3 + 1000).alias("dst_port"),
        F.when(is_dns, "udp").otherwise("tcp").alias("proto"),
        (F.col("l_quantity") * 1400).cast("int").alias("length"),
        F.when(is_dns, (order % 2).cast("int")).alias("dns_qr"),
        F.when(is_dns, query).alias("dns_query"),
        F.when(is_dns, F.element_at(F.array(*[F.lit(v) for v in (1, 28, 16, 5, 15)]),
                                    (order % 5 + 1).cast("int"))).alias("dns_qtype"),
        F.when(is_dns, (order % 7).cast("int")).alias("dns_rcode"),
    )


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host names of the crawled pages: the benign domains."""
    return table(spark, sf_dir, "pages").select(
        "page_id", F.parse_url(F.col("url"), F.lit("HOST")).alias("domain"))
