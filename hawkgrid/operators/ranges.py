"""Address ranges by longest prefix: which supplied range, IPv4 or IPv6, an address belongs to.

A range's prefix is a key: an address meets ranges of each prefix length by equality with its own leading bits. The distinct
lengths of a table are at most 129, so an address gives at most as many keys, and no range is compared with an address that
does not lie in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hawkgrid.functions.net import address_hex
from hawkgrid.operators.enrich import lookup_address


def prefix_key(address: Column, bits: Column) -> Column:
    """The first ``bits`` bits of an address in 32 hexadecimal digits: whole digits, then one with its lower bits cleared."""
    whole, rest = (bits / 4).cast("int"), bits % 4
    digit = F.conv(F.substr(address, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.pow(F.lit(2), 4 - rest).cast("int")
    cut = F.lower(F.hex(digit - digit % step))
    return F.concat(F.substr(address, F.lit(1), whole), F.when(rest == 0, "").otherwise(cut))


def parsed_ranges(ranges: DataFrame, cidr: str = "cidr") -> DataFrame:
    """``bits`` and ``prefix`` of each range ``address/length``; malformed ones are left out.

    The length of an IPv4 range counts from the 96 bits that every IPv4 address has in common. A length that is missing
    means a single address; bits behind the prefix are ignored.
    """
    text = F.trim(F.col(cidr))
    parts = F.split(text, "/", -1)
    address = address_hex(parts.getItem(0))
    four = ~parts.getItem(0).contains(":")
    given = F.when(F.size(parts) == 1, F.when(four, 32).otherwise(128)).otherwise(F.get(parts, F.lit(1)).try_cast("int"))
    bits = given + F.when(four, 96).otherwise(0)
    out = ranges.withColumns({"_address": address, "bits": bits}).where(
        (F.size(parts) <= 2) & F.col("_address").isNotNull() & (given >= 0) & (F.col("bits") <= 128))
    return out.withColumn("prefix", prefix_key(F.col("_address"), F.col("bits"))).drop("_address")


def longest_prefix(addresses: DataFrame, ranges: DataFrame, cidr: str = "cidr", ip: str = "ip") -> DataFrame:
    """Distinct addresses with the columns of the narrowest range around each, and its ``bits`` (of 128).

    Addresses in no range, and malformed ones, are left out. Of ranges with the same prefix the least row, column by column,
    counts. Ranges are never broadcast by hint; Spark checks their size.
    """
    values = [c for c in ranges.columns if c != cidr]
    known = parsed_ranges(ranges, cidr).groupBy("bits", "prefix").agg(F.min(F.struct(*values)).alias("_values"))
    # At most 129 rows.
    lengths = sorted(r["bits"] for r in known.select("bits").distinct().collect())
    if not lengths:
        return addresses.select(ip).limit(0).join(ranges.select(*values).limit(0).withColumn("bits", F.lit(0)), F.lit(False))
    keyed = (
        addresses.select(ip).distinct().withColumn("_address", address_hex(F.col(ip))).where("_address is not null")
        .withColumn("bits", F.explode(F.array(*[F.lit(n) for n in lengths])))
        .withColumn("prefix", prefix_key(F.col("_address"), F.col("bits"))))
    best = keyed.join(known, ["bits", "prefix"]).groupBy(ip).agg(
        F.max("bits").alias("bits"), F.max_by("_values", "bits").alias("_values"))
    return best.select(ip, *[F.col("_values")[c].alias(c) for c in values], "bits")


def intel_from_ranges(alerts: DataFrame, ranges: DataFrame) -> DataFrame:
    """Address intelligence (ip, city, country, isp, hosting) for the addresses of alerts, ready for ``enrich``."""
    addresses = alerts.select(lookup_address(alerts).alias("ip")).where("ip is not null")
    return longest_prefix(addresses, ranges.select("cidr", "city", "country", "isp", "hosting")).drop("bits")
