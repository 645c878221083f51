"""Connection features and connection-state mapping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisors of the flow vector, in the order
# originator bytes, responder bytes, duration, packets, byte ratio.
FLOW_SCALE = [15.0, 15.0, 10.0, 10.0, 10.0]


def bytes_per_second(orig_bytes: Column, resp_bytes: Column, duration: Column) -> Column:
    return F.when(duration > 0, (orig_bytes + resp_bytes) / duration).otherwise(F.lit(0.0))


def flow_vector(orig_bytes: Column, resp_bytes: Column, duration: Column, packets: Column) -> Column:
    """Five log-scaled measures of a connection's shape, as an array of doubles."""
    ratio = resp_bytes / F.greatest(orig_bytes.cast("double"), F.lit(1.0))
    measures = [orig_bytes, resp_bytes, duration, packets, ratio]
    return F.array(*[
        F.log1p(F.greatest(m.cast("double"), F.lit(0.0))) / scale
        for m, scale in zip(measures, FLOW_SCALE)
    ])


def zeek_state(argus_state: Column) -> Column:
    """Map a two-sided flow state ``origin_destination`` to S0, REJ or ''."""
    origin = F.regexp_extract(argus_state, "^([^_]*)_", 1)
    answer = F.regexp_extract(argus_state, "^[^_]*_(.*)$", 1)
    has_sides = argus_state.contains("_")
    return (
        F.when(~F.coalesce(has_sides, F.lit(False)), F.lit(""))
        .when(answer == "", F.lit("S0"))
        .when(origin.startswith("S") & answer.contains("R"), F.lit("REJ"))
        .otherwise(F.lit(""))
    )
