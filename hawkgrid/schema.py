"""Schemas of raw events and alerts."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D = T.StringType(), T.LongType(), T.DoubleType()


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


# Raw JSON log lines keep dotted endpoint names and text numbers ('-' stands for unset).
RAW_EVENT = _fields(
    ("ts", _D), ("uid", _S), ("id.orig_h", _S), ("id.orig_p", _S), ("id.resp_h", _S), ("id.resp_p", _S),
    ("proto", _S), ("service", _S), ("duration", _S), ("orig_bytes", _S), ("resp_bytes", _S),
    ("conn_state", _S), ("orig_pkts", _S), ("resp_pkts", _S), ("ja4", _S),
    ("query", _S), ("qtype_name", _S), ("rcode", _S), ("rcode_name", _S),
    ("answers", T.ArrayType(_S)), ("TTLs", T.ArrayType(T.IntegerType())),
    ("trace_id", _S), ("event_type", _S), ("seq", _L), ("tenant_id", _L),
)

ALERT = _fields(
    ("timestamp", _S), ("alert_id", _S), ("flow_id", _S), ("trace_id", _S), ("span_id", _S),
    ("event_type", _S), ("threat_class", _S), ("confidence_score", _D), ("severity", _S),
    ("mitre_tactic", _S), ("mitre_technique", _S), ("source_ip", _S), ("destination_ip", _S),
    ("evidence", _S), ("model_name", _S), ("model_version", _S), ("schema_version", _S),
    ("is_replay", T.BooleanType()),
)
