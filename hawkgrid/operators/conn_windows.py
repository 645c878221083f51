"""Trailing windows per (source, destination): connection rate, byte volume, beacon regularity.

Each connection adds itself when it arrives and takes itself out when it leaves a
window, so one running sum per measure gives every window at every row. Work is
n log n however busy a pair is, and ties count in arrival order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hawkgrid.functions import scan
from hawkgrid.functions.net import normalise_ip
from hawkgrid.operators.rules import BEACON, BYTE_VOLUME, CONN_RATE, detection, fire

SECOND = 1_000_000
PAIR = ["source_ip", "destination_ip"]


def conn_windows(
    conn: DataFrame,
    rate_window_s: float = 10.0,
    rate_min_count: int = 1000,
    bytes_window_s: float = 600.0,
    bytes_min_total: int = 1_000_000,
    beacon_window_s: float = 21600.0,
    beacon_min_observations: int = 3,
    beacon_max_cv: float = 0.5,
    beacon_min_interval_s: float = 5.0,
    hot_rows: int = scan.HOT_ROWS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Window statistics and flags right after each connection.

    Input: ``orig_h, resp_h, t_us, seq, orig_bytes`` (``seq`` unique) and the ``keep``
    columns. Windows include rows exactly at the lower bound, except the beacon window.
    """
    rate, volume, beacon = (int(s * SECOND) for s in (rate_window_s, bytes_window_s, beacon_window_s))
    rows = conn.select(
        normalise_ip("orig_h").alias("source_ip"),
        normalise_ip("resp_h").alias("destination_ip"),
        "t_us", "seq", F.greatest(F.col("orig_bytes"), F.lit(0)).cast("bigint").alias("_bytes"), *keep,
    ).where("source_ip is not null and destination_ip is not null and t_us is not null")
    hot = scan.find_hot(rows, PAIR, hot_rows)
    rows = scan.previous_values(rows, PAIR, ["t_us", "seq"], {"_pt": F.col("t_us")}, hot)

    t, b = F.col("t_us"), F.col("_bytes")
    gap = F.coalesce(t - F.col("_pt"), F.lit(0).cast("bigint"))
    gap_sq = gap.cast("decimal(19,0)") * gap.cast("decimal(19,0)")
    zero = F.lit(0).cast("bigint")
    zero_sq = F.lit(0).cast("decimal(38,0)")

    def step(at, order, count=zero, total=zero, n=zero, d=zero, d2=zero_sq, row=None):
        payload = F.struct(*[F.col(c) for c in ("t_us", *keep)])
        return F.struct(
            at.alias("_at"), F.lit(order).alias("_ord"), count.alias("_c"), total.alias("_b"), n.alias("_n"),
            d.alias("_d"), d2.cast("decimal(38,0)").alias("_d2"),
            (payload if row else F.when(F.lit(False), payload)).alias("_row"),
        )

    one = F.lit(1).cast("bigint")
    steps = F.array_compact(F.array(
        step(t, 1, one, b, one, gap, gap_sq, row=True),
        step(t + rate, 2, count=-one),
        F.when(b > 0, step(t + volume, 3, total=-b)),
        step(t + beacon, -2, n=-one),
        F.when(F.col("_pt").isNotNull(), step(F.col("_pt") + beacon, -1, d=-gap, d2=-gap_sq)),
    ))
    moves = rows.select(*PAIR, "seq", F.explode(steps).alias("_s")).select(*PAIR, "seq", "_s.*")
    sums = {
        "connection_count": F.col("_c"), "total_bytes": F.col("_b"), "observations": F.col("_n"),
        "_sd": F.col("_d"), "_sd2": F.col("_d2"),
    }
    moves_hot = None if hot is None else scan.HotKeys(hot.keys, hot.n_keys, hot.n_rows * 5, hot.hot_rows)
    state = scan.running_sums(moves, PAIR, ["_at", "_ord", "seq"], sums, moves_hot).where(
        F.col("_row").isNotNull())

    k = F.col("observations") - 1
    mean = F.when(k > 0, F.col("_sd") / k / SECOND)
    spread = F.greatest(
        (F.col("_sd2").cast("double") - F.col("_sd").cast("double") * F.col("_sd") / k) / (k - 1), F.lit(0.0))
    cv = F.when((k >= 2) & (F.col("_sd") > 0), F.sqrt(spread) / SECOND / mean)
    return state.select(
        *PAIR, "seq", F.col("_row.t_us").alias("t_us"), *[F.col(f"_row.{c}").alias(c) for c in keep],
        "connection_count", "total_bytes", "observations",
        mean.alias("mean_interval_seconds"), cv.alias("coefficient_of_variation"),
    ).select(
        "*",
        (F.col("connection_count") >= rate_min_count).alias("is_flood"),
        (F.col("total_bytes") >= bytes_min_total).alias("is_exfil"),
        F.coalesce(
            (F.col("observations") >= beacon_min_observations)
            & (F.col("mean_interval_seconds") >= beacon_min_interval_s)
            & (F.col("coefficient_of_variation") <= beacon_max_cv), F.lit(False)).alias("is_beacon"),
    )


def conn_window_detections(windows: DataFrame, rate_window_s: float = 10.0, bytes_window_s: float = 600.0) -> DataFrame:
    """Detections of the three windows, with the statistics as evidence."""
    dst = F.col("destination_ip")

    def evidence(*cols):
        return F.to_json(F.struct(dst, *cols))

    return fire(windows, [
        (F.col("is_flood"), detection(CONN_RATE, evidence(
            F.col("connection_count"), F.lit(rate_window_s).alias("window_seconds")))),
        (F.col("is_beacon"), detection(BEACON, evidence(
            F.col("observations"), F.col("mean_interval_seconds"), F.col("coefficient_of_variation")))),
        (F.col("is_exfil"), detection(BYTE_VOLUME, evidence(
            F.col("total_bytes"), F.lit(bytes_window_s).alias("window_seconds")))),
    ])
