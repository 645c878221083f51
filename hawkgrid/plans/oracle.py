"""SQL counterparts of the registered queries, for an independent engine on the same tables."""

from __future__ import annotations

import re

from hawkgrid.functions.net import INTERNAL_V4, PUBLIC_EXCEPTIONS_V4
from hawkgrid.functions.playbook_text import ALIASES, DEFAULT_KEY, TEMPLATES
from hawkgrid.functions.text import KNOWN_INFRA_SUFFIXES
from hawkgrid.operators.enrich import COUNTRIES, NETWORKS, SUSPICIOUS_COUNTRIES
from hawkgrid.plans.catalog import RULE_ORDER
from hawkgrid.sources.packets import QTYPES, RCODES


# Confidence of each detector, stated here again.
_CONFIDENCE = {
    "RULE_DDOS_VOLUMETRIC": 0.85, "RULE_C2_HEARTBEAT": 0.85, "RULE_RECON_PORT_SCAN": 0.75, "RULE_CONN_EXFIL": 0.85,
    "RULE_DDOS_CONN_RATE": 0.95, "RULE_C2_BEACON_PERIODIC": 0.40, "RULE_EXFIL_BYTE_VOLUME": 0.95,
}


def _q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _events(compress: int) -> dict[str, str]:
    suffix = "" if compress == 60 else f"_{compress}"
    conn = f"""
    SELECT seq, t_us, user_id, kind, tenant_id, orig_h, resp_h,
      CASE WHEN k % 5 = 0 THEN 443 WHEN k % 5 = 1 THEN 53 ELSE k + 1024 END AS resp_p,
      CASE kind WHEN 'error' THEN 'REJ' WHEN 'view' THEN 'S0' ELSE 'SF' END AS conn_state,
      CASE kind WHEN 'error' THEN k * 150 WHEN 'view' THEN k % 8 ELSE k + 5 END AS orig_pkts,
      CASE kind WHEN 'purchase' THEN CAST(floor(value * 60000) AS BIGINT) WHEN 'click' THEN k + 50
        ELSE CAST(floor(value * 10) AS BIGINT) END AS orig_bytes,
      CASE kind WHEN 'purchase' THEN k * 150 WHEN 'click' THEN (k * 7) % 110 + 50 ELSE k * 500 END AS resp_bytes,
      value / 10 AS duration,
      CASE WHEN k = 13 THEN 't13d000000_rare_fingerprint' ELSE 't13d1516h2_8daaf6152771_02713d6af862' END AS ja4
    FROM ev{suffix}"""
    dns = f"""
    SELECT seq, t_us, tenant_id, orig_h, resp_h,
      CASE WHEN k % 11 = 0 THEN md5(seq::VARCHAR) || md5(user_id::VARCHAR) || '.tunnel.example.com'
        WHEN k % 3 = 0 THEN substr(md5(seq::VARCHAR), 1, 12) ||
          translate(substr(md5(seq::VARCHAR), 13, 12), '0123456789abcdef', 'ghijklmnopqrstuv') || '.com'
        WHEN k % 7 = 0 THEN substr(md5(seq::VARCHAR), 1, 20) || '.cloudfront.net'
        ELSE 'www' || k::VARCHAR || '.example.com' END AS query,
      CASE WHEN k % 11 = 0 THEN 'TXT' ELSE 'A' END AS qtype_name,
      CASE WHEN k % 5 < 3 THEN 3 ELSE 0 END AS rcode
    FROM ev{suffix}"""
    ev = f"""
    SELECT event_id AS seq, (epoch_us(ts) - 1704067200000000) // {compress} AS t_us, user_id, event_type AS kind, value,
      CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
      '10.0.0.' || (user_id % 20 + 1)::VARCHAR AS orig_h, '45.3.0.' || (user_id % 3 + 1)::VARCHAR AS resp_h,
      user_id % 3 AS tenant_id
    FROM events"""
    return {f"ev{suffix}": ev, f"conn{suffix}": conn, f"dns{suffix}": dns}


def _previous(suffix: str) -> str:
    """Connections with the time of the pair's connection before."""
    return (f"SELECT *, lag(t_us) OVER (PARTITION BY orig_h, resp_h ORDER BY t_us, seq) AS pt FROM conn{suffix}")


_DET = "seq, t_us, tenant_id, orig_h AS source_ip, resp_h AS destination_ip"


def _rule(event: str, where: str, rule: str, cls: str, sev: str, conf: float, tactic: str, tech: str, ev: str) -> str:
    return (f"SELECT {_DET}, '{event}' AS event_type, '{rule}' AS rule_id, '{cls}' AS threat_class, '{sev}' AS severity, "
            f"CAST({conf} AS DOUBLE) AS confidence, {ev} AS evidence, '{tactic}' AS mitre_tactic, "
            f"'{tech}' AS mitre_technique FROM {'conn' if event == 'conn' else 'dns_feat'} WHERE {where}")


_SMALL = "orig_bytes > 50 AND orig_bytes < 150 AND resp_bytes > 50 AND resp_bytes < 150 AND resp_p NOT IN (80, 443, 53)"
_PKT = "json_object('conn_state', conn_state, 'orig_pkts', orig_pkts)::VARCHAR"
_C2 = "Command and Control"
_DGA = "DGA / DNS Tunnelling"
_ENT = ("list_sum(list_transform(list_distinct(list_filter(string_split({x}, ''), lambda c: c <> '')), lambda c: "
        "-((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE) * "
        "log2((length({x}) - length(replace({x}, c, ''))) / length({x})::DOUBLE)))")


def _entropy(x: str) -> str:
    return _ENT.replace("{x}", x)


_INFRA = "(" + " OR ".join(f"ends_with(lower(rtrim(query, '.')), '{s}')" for s in KNOWN_INFRA_SUFFIXES) + ")"
_WEIGHT = "CASE lower(severity) WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 50 ELSE 25 END"
_NAME = "CASE {w} WHEN 100 THEN 'critical' WHEN 75 THEN 'high' WHEN 50 THEN 'medium' ELSE 'low' END"
_CONF = "least(greatest(confidence_score, 0.01), 0.99)"
_POOL = "round(100.0 / (1.0 + exp(-sum(ln(best / (1 - best))))), {d})"
_MD5_180 = ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(md5({x}), ''), "
            "lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda acc, d: (acc * 16 + d) % 180)")


def _hexmod(x: str, digits: int, mod: int) -> str:
    return ("list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(md5(" + x + f"), 1, {digits}), ''), "
            "lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda acc, d: acc * 16 + d) % " + str(mod))


def _number(first: str) -> int:
    out = 0
    for octet in first.split("."):
        out = out * 256 + int(octet)
    return out


_IPNUM = ("(split_part({x}, '.', 1)::BIGINT * 16777216 + split_part({x}, '.', 2)::BIGINT * 65536 "
          "+ split_part({x}, '.', 3)::BIGINT * 256 + split_part({x}, '.', 4)::BIGINT)")


def _internal(x: str) -> str:
    number = _IPNUM.replace("{x}", x)
    blocks = " OR ".join(
        f"{number} BETWEEN {_number(f)} AND {_number(f) + 2 ** (32 - p) - 1}" for f, p in INTERNAL_V4)
    return f"(({blocks}) AND {x} NOT IN ({', '.join(_q(v) for v in PUBLIC_EXCEPTIONS_V4)}))"


def _named(code: str, names: dict[int, str]) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {n} THEN '{v}'" for n, v in names.items()) + f" ELSE {code}::VARCHAR END"


_TRIAGE = f"{_list(['open', 'acknowledged', 'false_positive', 'confirmed'])}[{_hexmod('incident_id', 4, 4)} + 1]"
_INC = "'INC-' || replace(source_ip, '.', '-')"

CTES: dict[str, str] = {
    **_events(60), **_events(3600), **_events(600),
    "dns_feat": f"""
    SELECT *, split_part(query, '.', 1) AS label, {_entropy("split_part(query, '.', 1)")} AS label_entropy FROM dns""",
    "det": " UNION ALL ".join([
        _rule("conn", "orig_pkts > 10000", "RULE_DDOS_VOLUMETRIC", "DDoS", "critical", 0.95, "Impact", "T1498", _PKT),
        _rule("conn", "orig_pkts <= 10000 AND conn_state = 'REJ' AND orig_pkts >= 100", "RULE_DDOS_VOLUMETRIC", "DDoS",
              "high", 0.85, "Impact", "T1498", _PKT),
        _rule("conn", _SMALL, "RULE_C2_HEARTBEAT", "C2 Beaconing", "high", 0.85, _C2, "T1132",
              "json_object('orig_bytes', orig_bytes, 'resp_bytes', resp_bytes, 'port', resp_p)::VARCHAR"),
        _rule("conn", "ja4 = 't13d000000_rare_fingerprint'", "RULE_TLS_JA4_MALWARE", "Encrypted-Traffic Malware",
              "critical", 0.95, "Defense Evasion", "T1573",
              "json_object('ja4_fingerprint', ja4, 'tls_metadata', 'Anomalous Cipher Suite')::VARCHAR"),
        _rule("conn", "conn_state = 'S0' AND orig_pkts < 5", "RULE_RECON_PORT_SCAN", "Reconnaissance", "low", 0.75,
              "Discovery", "T1046", "json_object('conn_state', 'S0', 'target_port', resp_p)::VARCHAR"),
        _rule("conn", "orig_bytes > 5000000 AND resp_bytes < 10000", "RULE_CONN_EXFIL", "Data Exfiltration", "high",
              0.85, "Exfiltration", "T1048",
              "json_object('orig_bytes', orig_bytes, 'resp_bytes', resp_bytes)::VARCHAR"),
        _rule("dns", "length(query) > 60 AND qtype_name = 'TXT'", "RULE_DNS_TUNNELLING", _DGA, "high", 0.90, _C2,
              "T1071.004", "json_object('query_length', length(query), 'qtype', 'TXT')::VARCHAR"),
        _rule("dns", f"label_entropy > 3.8 AND length(label) >= 16 AND NOT {_INFRA}", "RULE_DNS_DGA_FALLBACK", _DGA,
              "medium", 0.80, _C2, "T1568.002",
              "json_object('shannon_entropy', label_entropy, 'query', query)::VARCHAR"),
    ]),
    "alerts": f"""
    SELECT seq * 16 + list_position({_list(RULE_ORDER)}, rule_id) AS id, rule_id || '-' || seq::VARCHAR AS alert_id, t_us,
      tenant_id, source_ip, destination_ip, event_type, threat_class, severity, confidence AS confidence_score,
      evidence, rule_id AS model_name, mitre_tactic, mitre_technique, seq AS event_seq FROM det""",
    "inc_det": f"""
    SELECT source_ip, model_name, max({_CONF}) AS best, count(*) AS n, max({_WEIGHT}) AS w,
      min(t_us) AS f, max(t_us) AS l, tenant_id FROM alerts GROUP BY source_ip, model_name, tenant_id""",
    "inc": f"""
    SELECT source_ip, {_INC} AS incident_id, {_NAME.replace('{w}', 'max(w)')} AS severity,
      {_POOL.replace('{d}', '2')} AS risk_score, min(f) AS first_seen_us, CAST(sum(n) AS BIGINT) AS alert_count,
      string_agg(DISTINCT cls, ',' ORDER BY cls) AS threat_classes
    FROM (SELECT source_ip, model_name, max(best) AS best, sum(n) AS n, max(w) AS w, min(f) AS f
          FROM inc_det GROUP BY source_ip, model_name)
      JOIN (SELECT DISTINCT model_name, threat_class AS cls FROM alerts) USING (model_name) GROUP BY source_ip""",
    "queue": f"SELECT *, {_TRIAGE} AS triage_status FROM inc",
    "entities": f"""
    SELECT DISTINCT {_INC} AS incident_id, unnest([source_ip, destination_ip]) AS entity FROM alerts""",
    **{f"prev{s}": _previous(s) for s in ("", "_3600")},
    **{f"moves{s}": f"""
    SELECT orig_h, resp_h, seq, t_us AS at_us, 1 AS ord, 1 AS c, greatest(orig_bytes, 0) AS b, 1 AS n,
      coalesce(t_us - pt, 0) AS d, coalesce(t_us - pt, 0)::HUGEINT * coalesce(t_us - pt, 0) AS d2, t_us, TRUE AS own FROM prev{s}
    UNION ALL SELECT orig_h, resp_h, seq, t_us + 10000000, 2, -1, 0, 0, 0, 0, t_us, FALSE FROM prev{s}
    UNION ALL SELECT orig_h, resp_h, seq, t_us + 600000000, 2, 0, -greatest(orig_bytes, 0), 0, 0, 0, t_us, FALSE FROM prev{s}
    UNION ALL SELECT orig_h, resp_h, seq, t_us + 21600000000, 0, 0, 0, -1, 0, 0, t_us, FALSE FROM prev{s}
    UNION ALL SELECT orig_h, resp_h, seq, pt + 21600000000, 0, 0, 0, 0, -(t_us - pt), -((t_us - pt)::HUGEINT * (t_us - pt)),
      t_us, FALSE FROM prev{s} WHERE pt IS NOT NULL""" for s in ("", "_3600")},
    **{f"state{s}": f"""
    SELECT orig_h AS source_ip, resp_h AS destination_ip, seq, t_us, c::BIGINT AS connection_count, b::BIGINT AS total_bytes,
      n::BIGINT AS observations, CASE WHEN n > 1 THEN d::DOUBLE / (n - 1) / 1000000 END AS mean_s,
      CASE WHEN n > 2 AND d > 0 THEN
        sqrt(greatest((d2::DOUBLE - d::DOUBLE * d::DOUBLE / (n - 1)) / (n - 2), 0)) / 1000000 / (d::DOUBLE / (n - 1) / 1000000)
      END AS cv
    FROM (SELECT orig_h, resp_h, seq, t_us, own, sum(c) OVER w AS c, sum(b) OVER w AS b, sum(n) OVER w AS n,
        sum(d) OVER w AS d, sum(d2) OVER w AS d2 FROM moves{s}
      WINDOW w AS (PARTITION BY orig_h, resp_h ORDER BY at_us, ord, seq ROWS UNBOUNDED PRECEDING)) WHERE own""" for s in ("", "_3600")},
    "hits": f"""
    SELECT c.*, c.user_id % 4 = 0 AS is_botnet, c.user_id % 13 AS scenario,
      c.orig_pkts > 10000 OR (conn_state = 'REJ' AND orig_pkts >= 100) AS "RULE_DDOS_VOLUMETRIC",
      {_SMALL} AS "RULE_C2_HEARTBEAT", conn_state = 'S0' AND orig_pkts < 5 AS "RULE_RECON_PORT_SCAN",
      orig_bytes > 5000000 AND resp_bytes < 10000 AS "RULE_CONN_EXFIL",
      s.connection_count >= 4 AS "RULE_DDOS_CONN_RATE",
      coalesce(s.observations >= 3 AND s.mean_s >= 5 AND s.cv <= 0.5, FALSE) AS "RULE_C2_BEACON_PERIODIC",
      s.total_bytes >= 1000000 AS "RULE_EXFIL_BYTE_VOLUME"
    FROM conn c JOIN state s USING (seq)""",
    "hit_long": "SELECT is_botnet, t_us, detector, hit FROM (" + " UNION ALL ".join(
        f"SELECT is_botnet, t_us, '{n}' AS detector, \"{n}\" AS hit FROM hits" for n in _CONFIDENCE) + ")",
    "dns_q": """
    SELECT orig_h AS source_ip, t_us, seq, query, CASE WHEN t_us - lag(t_us) OVER w <= 60000000 THEN 0 ELSE 1 END AS opens
    FROM dns_600 WINDOW w AS (PARTITION BY orig_h ORDER BY t_us, seq)""",
    "dns_s": """
    SELECT *, sum(opens) OVER (PARTITION BY source_ip ORDER BY t_us, seq) AS session FROM dns_q""",
    "dns_n": """
    SELECT *, sum(is_first) OVER (PARTITION BY source_ip, session ORDER BY t_us, seq) AS distinct_n FROM (
      SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_ip, session, query ORDER BY t_us, seq) = 1 THEN 1 ELSE 0 END
        AS is_first FROM dns_s)""",
    **{name: f"""
    SELECT source_ip, t_us, seq, row_number() OVER (PARTITION BY source_ip, s ORDER BY t_us, seq) AS n FROM (
      SELECT *, sum(o) OVER (PARTITION BY source_ip ORDER BY t_us, seq) AS s FROM (
        SELECT orig_h AS source_ip, t_us, seq,
          CASE WHEN t_us - lag(t_us) OVER (PARTITION BY orig_h ORDER BY t_us, seq) <= 60000000 THEN 0 ELSE 1 END AS o
        FROM dns_600 WHERE {cond}))""" for name, cond in (("resp_n", "TRUE"), ("nx_n", "rcode = 3"))},
    "dns_state": """
    SELECT q.source_ip, q.t_us, q.seq, q.distinct_n::BIGINT AS distinct_domains,
      coalesce(CASE WHEN q.t_us - r.t_us <= 60000000 THEN r.n END, 0)::BIGINT AS total_responses,
      coalesce(CASE WHEN q.t_us - x.t_us <= 60000000 THEN x.n END, 0)::BIGINT AS nx
    FROM dns_n q
      ASOF LEFT JOIN (SELECT *, t_us::HUGEINT * 1000000000000 + seq AS k FROM resp_n) r
        ON q.source_ip = r.source_ip AND q.t_us::HUGEINT * 1000000000000 + q.seq > r.k
      ASOF LEFT JOIN (SELECT *, t_us::HUGEINT * 1000000000000 + seq AS k FROM nx_n) x
        ON q.source_ip = x.source_ip AND q.t_us::HUGEINT * 1000000000000 + q.seq > x.k""",
    "feed": """
    SELECT id AS seq, t_us, alert_id, source_ip, destination_ip, threat_class, severity, confidence_score, model_name,
      mitre_tactic, FALSE AS is_replay FROM alerts
    UNION ALL SELECT id + 1000000000000000, t_us + 30000000, alert_id, source_ip, destination_ip, threat_class, severity,
      confidence_score, model_name, mitre_tactic, id % 20 = 0 FROM alerts WHERE id % 10 = 0""",
    "packets": """
    SELECT epoch_us(l_shipdate) AS t_us, l_orderkey * 8 + l_linenumber AS seq,
      '10.1.0.' || (l_suppkey % 50 + 1)::VARCHAR AS src_ip, CASE WHEN l_linenumber = 1 THEN 53 ELSE l_linenumber + 1000 END AS src_port,
      '10.1.0.' || (l_partkey % 50 + 1)::VARCHAR AS dst_ip, CASE WHEN l_linenumber = 1 THEN 53 ELSE l_linenumber % 3 + 1000 END AS dst_port,
      CASE WHEN l_linenumber = 1 THEN 'udp' ELSE 'tcp' END AS proto, CAST(l_quantity * 1400 AS INTEGER) AS length,
      CASE WHEN l_linenumber = 1 THEN l_orderkey % 2 END AS dns_qr,
      CASE WHEN l_linenumber = 1 THEN 'host' || (l_partkey % 100)::VARCHAR || '.example.com.' END AS dns_query,
      CASE WHEN l_linenumber = 1 THEN [1, 28, 16, 5, 15][l_orderkey % 5 + 1] END AS dns_qtype,
      CASE WHEN l_linenumber = 1 THEN l_orderkey % 7 END AS dns_rcode
    FROM lineitem""",
    "packet_keys": """
    SELECT *, least(src_ip || ':' || src_port::VARCHAR, dst_ip || ':' || dst_port::VARCHAR) AS lo,
      greatest(src_ip || ':' || src_port::VARCHAR, dst_ip || ':' || dst_port::VARCHAR) AS hi
    FROM packets WHERE length <= 65535""",
    "packet_first": """
    SELECT *, first_value(src_ip || ':' || src_port::VARCHAR) OVER w AS o, row_number() OVER w AS rn
    FROM packet_keys WINDOW w AS (PARTITION BY lo, hi, proto ORDER BY t_us, seq)""",
    "flows": """
    SELECT split_part(o, ':', 1) AS orig_h, split_part(o, ':', 2)::INTEGER AS orig_p,
      split_part(CASE WHEN o = lo THEN hi ELSE lo END, ':', 1) AS resp_h,
      split_part(CASE WHEN o = lo THEN hi ELSE lo END, ':', 2)::INTEGER AS resp_p, proto,
      count(*) FILTER (WHERE own) AS orig_pkts, count(*) FILTER (WHERE NOT own) AS resp_pkts,
      CAST(coalesce(sum(length) FILTER (WHERE own), 0) AS BIGINT) AS orig_bytes,
      CAST(coalesce(sum(length) FILTER (WHERE NOT own), 0) AS BIGINT) AS resp_bytes,
      round((max(t_us) - min(t_us)) / 1000000.0, 3)::DOUBLE AS duration, min(t_us) AS t_us, min(seq) FILTER (WHERE rn = 1) AS seq
    FROM (SELECT *, CASE WHEN lo = hi THEN rn = 1 ELSE src_ip || ':' || src_port::VARCHAR = o END AS own FROM packet_first)
    GROUP BY lo, hi, o, proto""",
    "lines": """
    SELECT seq, t_us, orig_h, resp_p, conn_state, CASE WHEN seq % 9 = 0 THEN 0 ELSE orig_bytes END AS orig_bytes, orig_pkts,
      seq % 50 AS m FROM conn""",
    "templates": "SELECT * FROM (VALUES " + ", ".join(
        f"({_q(k)}, {_q(t)}, {_q('|'.join(s))}, {_q(f)}, {_q('|'.join(c))}, {_q('|'.join(m))})"
        for k, t, s, f, c, m in TEMPLATES) + ") AS t(key, title, steps, rule, checklist, mitigations)",
    "aliases": "SELECT * FROM (VALUES " + ", ".join(f"({_q(a)}, {_q(k)})" for a, k in ALIASES) + ") AS a(alias, key)",
    "triage_log": f"""
    SELECT tenant_id, 'INC-' || replace(orig_h, '.', '-') AS incident_id,
      {_list(['open', 'acknowledged', 'false_positive', 'confirmed', 'bogus'])}[seq % 5 + 1] AS status,
      t_us * 100000 + seq AS updated_us FROM conn""",
    "hosts": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS domain FROM pages",
}

# The sequential part of correlation: anchors by recursion, then positions and triggers.
_ANCHOR = """{name}({keys}, anchor) AS (
  SELECT {keys}, min(t_us) FROM {rows} GROUP BY {keys}
  UNION ALL
  SELECT {qkeys}, min(r.t_us) FROM {name} a JOIN {rows} r ON {on} AND r.t_us > a.anchor + 300000000 GROUP BY {qkeys}, a.anchor
)"""


def _correlation(feed: str, tail: str) -> str:
    def anchor(name, keys, rows):
        cols = keys.split(", ")
        return _ANCHOR.format(name=name, keys=keys, rows=rows, qkeys=", ".join(f"a.{c}" for c in cols),
                              on=" AND ".join(f"a.{c} = r.{c}" for c in cols))

    body = f"""
  corr_in AS (SELECT *, {_WEIGHT} AS weight,
    left(replace(regexp_replace(threat_class, '[^A-Za-z0-9_ ]', '', 'g'), ' ', '_'), 64) AS safe_class FROM {feed}),
  {anchor("src_anchor", "source_ip", "corr_in")},
  corr_a AS (SELECT r.*, a.anchor FROM corr_in r ASOF JOIN src_anchor a ON r.source_ip = a.source_ip AND r.t_us >= a.anchor),
  corr_d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_ip, anchor, alert_id ORDER BY t_us, seq) AS copy_no
    FROM corr_a) WHERE copy_no = 1 OR is_replay),
  {anchor("cls_anchor", "source_ip, safe_class", "corr_d")},
  corr_n AS (SELECT d.*, c.anchor AS class_anchor,
      row_number() OVER (PARTITION BY d.source_ip, d.anchor ORDER BY d.t_us, d.seq) AS n
    FROM corr_d d ASOF JOIN cls_anchor c ON d.source_ip = c.source_ip AND d.safe_class = c.safe_class AND d.t_us >= c.anchor),
  corr_m AS (SELECT *, coalesce(max(weight) OVER (PARTITION BY source_ip, safe_class, class_anchor ORDER BY t_us, seq
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS recorded FROM corr_n),
  corr_state AS (SELECT *, n >= 2 AND (recorded = 0 OR weight > recorded OR n = 2 OR n % 5 = 0) AS trig FROM corr_m)
"""
    return "WITH RECURSIVE " + _with(["feed"]) + ", " + body + tail


def _needs(sql: str) -> list[str]:
    """Names of the shared expressions a statement uses, each after what it needs itself."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"(FROM|JOIN)\s+\(?{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def _with(names: list[str]) -> str:
    order: list[str] = []
    for name in names:
        for inner in [*_needs(CTES[name]), name]:
            if inner not in order:
                order.append(inner)
    return ",\n".join(f"{n} AS ({CTES[n]})" for n in order)


def _sql(body: str) -> str:
    names = _needs(body)
    if names and body.lstrip().startswith("WITH "):
        return "WITH " + _with(names) + ",\n" + body.lstrip().removeprefix("WITH ")
    return ("WITH " + _with(names) + "\n" if names else "") + body


_CELLS = ("count(*) FILTER (WHERE {h} AND {l}) AS tp, count(*) FILTER (WHERE {h} AND NOT {l}) AS fp, "
          "count(*) FILTER (WHERE NOT {h} AND NOT {l}) AS tn, count(*) FILTER (WHERE NOT {h} AND {l}) AS fn")


def _safe(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b}) END"


def _with_metrics(keys: str, inner: str, digits: int | None = 6) -> str:
    r = (lambda e, n: f"round({e}, {digits}) AS {n}") if digits else (lambda e, n: f"{e} AS {n}")
    return f"""
    SELECT {keys}, tp, fp, tn, fn, {r("accuracy", "accuracy")}, {r("precision_", '"precision"')}, {r("recall", "recall")}, {r("fpr", "fpr")},
      {r(_safe("2 * precision_ * recall", "precision_ + recall"), "f1")}
    FROM (SELECT *, {_safe("tp + tn", "tp + fp + tn + fn")} AS accuracy, {_safe("tp", "tp + fp")} AS precision_,
      {_safe("tp", "tp + fn")} AS recall, {_safe("fp", "fp + tn")} AS fpr FROM ({inner}))"""


def _cells(hit: str, label: str) -> str:
    return _CELLS.replace("{h}", f"({hit})").replace("{l}", f"({label})")


_V = "lower(rtrim(query, '.'))"
_PARTS = f"list_filter(string_split(regexp_replace({_V}, '[^a-z0-9.-]', '-', 'g'), '.'), lambda p: p <> '')"
_VARIANTS = f"""
    SELECT seq, list_distinct_ordered AS v FROM (
      SELECT seq, list_transform(list_filter(list_zip(xs, range(1, len(xs) + 1)),
        lambda z: list_position(xs, z[1]) = z[2]), lambda z: z[1]) AS list_distinct_ordered FROM (
        SELECT seq, list_concat([regexp_replace({_V}, '[^a-z0-9.-]', '-', 'g')],
          CASE WHEN len({_PARTS}) >= 2 THEN list_concat([array_to_string(list_slice({_PARTS}, -2, -1), '.')],
            list_filter({_PARTS}, lambda p: length(p) >= 4)) ELSE [] END) AS xs FROM dns))"""
_REG = ("CASE WHEN len(list_filter(string_split(lower(rtrim({x}, '.')), '.'), lambda p: p <> '')) >= 2 THEN "
        "array_to_string(list_slice(list_filter(string_split(lower(rtrim({x}, '.')), '.'), lambda p: p <> ''), -2, -1), '.') END")
_DIST = "len(list_distinct(list_filter(string_split(label, ''), lambda c: c <> '')))"
_RUN = ("list_max(list_transform(string_split(regexp_replace(label, '[^b-df-hj-np-tv-z]', ' ', 'g'), ' '), lambda r: length(r)))")
_AGE = "floor((43200000000 - t_us) / 1000000.0 / {d})::BIGINT::VARCHAR"
_EV_KEYS = "json_keys(evidence)"
_INFERRED = ("(contains(lower(x), 'score') OR contains(lower(x), 'ml_') OR contains(lower(x), 'entropy') "
             "OR contains(lower(x), 'confidence') OR contains(lower(x), 'latency'))")
_REGISTERED = "-(" + _hexmod("domain", 3, 400) + ") * 86400000000"


def _bodies() -> dict[str, str]:
    det = "seq, rule_id, threat_class, severity, confidence"
    mitre = "mitre_tactic, mitre_technique"
    reason_d = "distinct_domains >= 40"
    reason_x = "distinct_domains < 40 AND total_responses >= 8 AND nx::DOUBLE / total_responses >= 0.5"
    beacon = "observations >= 3 AND mean_s >= 5 AND cv <= 0.5"
    fill = "rule"
    for name, value in (("src_ip", "source_ip"), ("dst_ip", "destination_ip"), ("dst_port", "'443'"), ("domain", "dom")):
        fill = f"replace({fill}, '{{{name}}}', {value})"
    return {
        "rules_conn": f"SELECT {det}, evidence, {mitre} FROM det WHERE event_type = 'conn'",
        "rules_dns": f"SELECT {det}, {mitre} FROM det WHERE event_type = 'dns'",
        "ja4_table": "SELECT seq, rule_id, severity FROM det WHERE rule_id = 'RULE_TLS_JA4_MALWARE'",
        "dns_features": f"""SELECT seq, length(query)::BIGINT AS domain_length, round({_entropy('query')}, 6) AS shannon_entropy,
            round(label_entropy, 6) AS label_entropy, length(label)::BIGINT AS label_length,
            round(length(regexp_replace(query, '[^0-9]', '', 'g')) / length(query)::DOUBLE, 6) AS digit_ratio,
            {_INFRA} AS is_known_infra_suffix FROM dns_feat""",
        "flow_features": """SELECT seq, duration, orig_bytes, resp_bytes, round(CASE WHEN duration > 0
            THEN (orig_bytes + resp_bytes) / duration ELSE 0 END, 3) AS bytes_per_sec FROM conn""",
        "lexical_features": f"""SELECT seq, round(least(length(label) / 63.0::DOUBLE, 1), 6) AS length,
            round(least(label_entropy / 5.25::DOUBLE, 1), 6) AS entropy,
            round(length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)::DOUBLE, 6) AS digits,
            round(length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label)::DOUBLE, 6) AS vowels,
            round({_DIST} / length(label)::DOUBLE, 6) AS "distinct",
            round(least({_RUN} / 10.0::DOUBLE, 1), 6) AS consonant_run,
            round((length(label) - length(replace(label, '-', ''))) / length(label)::DOUBLE, 6) AS hyphens FROM dns_feat""",
        "name_variants": f"SELECT seq, array_to_string(v, '|') AS variants FROM ({_VARIANTS})",
        "character_windows": f"""SELECT seq, len(w)::BIGINT AS window_count, md5(array_to_string(w, '|')) AS windows_md5 FROM (
            SELECT seq, flatten(list_transform(v, lambda n: CASE WHEN length(n) > 35 THEN list_concat(
              list_transform(range(1, length(n) - 33, 15), lambda i: substr(n, i, 35)),
              CASE WHEN (length(n) - 35) % 15 <> 0 THEN [right(n, 35)] ELSE [] END)
              ELSE [n] END)) AS w FROM ({_VARIANTS}))""",
        "flow_vectors": "SELECT seq, " + ", ".join(
            f"round(ln(1 + greatest(0, {e})::DOUBLE) / {s}, 6) AS v{i}" for i, (e, s) in enumerate([
                ("orig_bytes", 15), ("resp_bytes", 15), ("duration", 10), ("orig_pkts", 10),
                ("resp_bytes / greatest(1.0::DOUBLE, orig_bytes::DOUBLE)", 10)])) + " FROM conn",
        "registrable_domains": f"SELECT page_id, {_REG.replace('{x}', 'domain')} AS registrable FROM hosts",
        "zeek_states": """SELECT seq, CASE conn_state WHEN 'S0' THEN 'S0' WHEN 'REJ' THEN 'REJ' ELSE '' END AS zeek_state FROM conn""",
        "display_columns": f"""SELECT id, mitre_tactic || ' (' || mitre_technique || ')' AS mitre,
            CASE WHEN (43200000000 - t_us) / 1000000.0 < 60 THEN 'just now'
              WHEN (43200000000 - t_us) / 1000000.0 < 3600 THEN {_AGE.replace('{d}', '60')} || 'm ago'
              WHEN (43200000000 - t_us) / 1000000.0 < 86400 THEN {_AGE.replace('{d}', '3600')} || 'h ago' ELSE '' END AS age,
            replace(replace(alert_id, '_', '\\_'), '-', '\\-') AS escaped,
            strftime(make_timestamp(t_us), '%Y-%m-%d %H:%M:%S UTC') AS shown_at FROM alerts""",
        "evidence_split": f"""SELECT id, array_to_string(list_sort(list_filter({_EV_KEYS}, lambda x: NOT {_INFERRED})), ',') AS observed,
            array_to_string(list_sort(list_filter({_EV_KEYS}, lambda x: {_INFERRED})), ',') AS inferred,
            '' AS unknown FROM alerts""",
        "conn_rate": "SELECT seq, source_ip, destination_ip, connection_count FROM state_3600 WHERE connection_count >= 4",
        "bulk_exfil": "SELECT seq, source_ip, destination_ip, total_bytes FROM state WHERE total_bytes >= 1000000",
        "beacon_periodic": f"""SELECT seq, source_ip, destination_ip, observations, round(mean_s, 3) AS mean_interval_seconds,
            round(cv, 5) AS coefficient_of_variation FROM state WHERE {beacon}""",
        "conn_window_alerts": f"""SELECT seq, 'RULE_DDOS_CONN_RATE' AS rule_id, 'critical' AS severity, 0.95::DOUBLE AS confidence
            FROM state WHERE connection_count >= 4 UNION ALL SELECT seq, 'RULE_C2_BEACON_PERIODIC', 'medium', 0.40::DOUBLE FROM state
            WHERE {beacon} UNION ALL SELECT seq, 'RULE_EXFIL_BYTE_VOLUME', 'critical', 0.95::DOUBLE FROM state WHERE total_bytes >= 1000000""",
        "flow_windows": """SELECT f.seq, f.orig_h AS source_ip, f.resp_h AS destination_ip, CAST(sum(g.orig_bytes) AS BIGINT) AS total_bytes,
            count(*) FILTER (WHERE g.t_us >= f.t_us - 10000000) AS connection_count
            FROM flows f JOIN flows g ON f.orig_h = g.orig_h AND f.resp_h = g.resp_h AND g.t_us >= f.t_us - 600000000
              AND (g.t_us < f.t_us OR (g.t_us = f.t_us AND g.seq <= f.seq))
            GROUP BY ALL HAVING sum(g.orig_bytes) >= 300000""",
        "dns_burst_distinct": f"SELECT seq, source_ip, distinct_domains FROM dns_state WHERE {reason_d}",
        "dns_burst_large": """SELECT * FROM (WITH q AS (
              SELECT orig_h AS source_ip, t_us, seq, query, CASE WHEN t_us - lag(t_us) OVER w <= 3600000000 THEN 0 ELSE 1 END AS opens
              FROM dns_600 WINDOW w AS (PARTITION BY orig_h ORDER BY t_us, seq)),
            s AS (SELECT *, sum(opens) OVER (PARTITION BY source_ip ORDER BY t_us, seq) AS session FROM q),
            f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY source_ip, session, query ORDER BY t_us, seq) = 1 THEN 1 ELSE 0 END AS one FROM s),
            d AS (SELECT seq, source_ip, sum(one) OVER (PARTITION BY source_ip, session ORDER BY t_us, seq)::BIGINT AS distinct_domains FROM f)
            SELECT * FROM d WHERE distinct_domains >= 300)""",
        "dns_burst_nxdomain": f"""SELECT seq, source_ip, distinct_domains, total_responses,
            round(nx::DOUBLE / total_responses, 6) AS nxdomain_rate FROM dns_state WHERE {reason_x}""",
        "dns_window_alerts": f"""SELECT seq, 'RULE_DNS_QUERY_BURST' AS rule_id, CASE WHEN {reason_d} THEN 'high' ELSE 'medium' END
            AS severity FROM dns_state WHERE {reason_d} OR ({reason_x})""",
        "risk_score": f"""SELECT source_ip, destination_ip, count(*) AS detectors, {_POOL.replace('{d}', '1')} AS risk_score FROM (
            SELECT source_ip, destination_ip, model_name, max({_CONF}) AS best FROM alerts GROUP BY ALL) GROUP BY ALL""",
        "incidents_by_source": f"""SELECT tenant_id, source_ip, {_INC} AS incident_id, {_NAME.replace('{w}', 'max(w)')} AS severity,
            {_POOL.replace('{d}', '1')} AS risk_score, CAST(sum(n) AS BIGINT) AS alert_count, min(f) AS first_seen_us,
            max(l) AS last_seen_us, any_value(c) AS threat_classes, any_value(ta) AS mitre_tactics, any_value(te) AS mitre_techniques,
            'Aggregated ' || CAST(sum(n) AS BIGINT)::VARCHAR || ' alert(s) across ' || any_value(nc)::VARCHAR ||
              ' threat class(es) involving ' || source_ip AS evidence_summary, 'active' AS status
            FROM inc_det JOIN (SELECT tenant_id, source_ip, string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS c,
              string_agg(DISTINCT mitre_tactic, ',' ORDER BY mitre_tactic) AS ta, count(DISTINCT threat_class) AS nc,
              string_agg(DISTINCT mitre_technique, ',' ORDER BY mitre_technique) AS te FROM alerts GROUP BY ALL)
            USING (tenant_id, source_ip) GROUP BY tenant_id, source_ip""",
        "incidents_page": f"""SELECT {_INC} AS incident_id, {_NAME.replace('{w}', f'max({_WEIGHT})')} AS severity, any_value(risk) AS risk_score,
            count(*) AS alert_count, string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS threat_classes,
            array_to_string(list_sort(list_distinct(list_append(list(destination_ip), source_ip))), ',') AS affected_entities,
            string_agg(alert_id, ',' ORDER BY alert_id) AS related_alert_ids
            FROM (SELECT * FROM alerts WHERE tenant_id = 1 ORDER BY id DESC LIMIT 100) JOIN (
              SELECT source_ip, {_POOL.replace('{d}', '1')} AS risk FROM (SELECT source_ip, model_name, max({_CONF}) AS best FROM (
                SELECT * FROM alerts WHERE tenant_id = 1 ORDER BY id DESC LIMIT 100) GROUP BY ALL) GROUP BY source_ip)
            USING (source_ip) GROUP BY source_ip""",
        "incident_members": f"SELECT {_INC} AS incident_id, alert_id FROM alerts",
        "incident_entities": "SELECT incident_id, entity FROM entities",
        "tenant_queue": f"""SELECT tenant_id, incident_id, {_list(['open', 'acknowledged', 'false_positive', 'confirmed'])}[
            (('0x' || substr(md5(incident_id), 1, 4))::BIGINT + tenant_id) % 4 + 1] AS triage_status
            FROM (SELECT DISTINCT tenant_id, {_INC} AS incident_id FROM alerts)""",
        "incident_detail": "SELECT alert_id, t_us, severity FROM alerts WHERE source_ip = '10.0.0.7'",
        "incident_queue": """SELECT incident_id, severity, round(risk_score, 1) AS risk_score, triage_status FROM queue
            WHERE triage_status <> 'false_positive' AND (contains(lower(incident_id || ' ' || threat_classes), '10.0.0.1')
              OR incident_id IN (SELECT incident_id FROM entities WHERE contains(entity, '10.0.0.1')))""",
        "console_queue": """SELECT incident_id, severity, 'ACK' AS status_label FROM queue WHERE triage_status = 'acknowledged'""",
        "console_target": """SELECT incident_id, severity, CASE triage_status WHEN 'acknowledged' THEN 'ACK' WHEN 'false_positive' THEN 'FALSE POS' ELSE upper(triage_status) END AS status_label
            FROM queue WHERE incident_id IN (SELECT 'INC-' || replace(source_ip, '.', '-') FROM alerts WHERE destination_ip LIKE '%45.3.0.2%')""",
        "queue_kpis": """SELECT count(*) FILTER (WHERE triage_status = 'open') AS needs_triage,
            count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high,
            count(*) FILTER (WHERE triage_status <> 'false_positive') AS active,
            count(*) FILTER (WHERE triage_status = 'false_positive') AS dismissed,
            round(avg(risk_score) FILTER (WHERE triage_status <> 'false_positive'), 1) AS avg_risk FROM queue""",
        "severity_stats": "SELECT count(*) AS total_alerts, " + ", ".join(
            f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low")
        ) + " FROM alerts WHERE tenant_id = 1",
        "alert_page": """SELECT id, alert_id, source_ip, severity FROM alerts WHERE tenant_id = 1 AND id < 5000
            ORDER BY id DESC LIMIT 50""",
        "alert_by_id": "SELECT id, alert_id, t_us FROM alerts WHERE alert_id = 'RULE_TLS_JA4_MALWARE-45'",
        "entity_search": """SELECT id, source_ip, destination_ip FROM alerts
            WHERE source_ip = '45.3.0.2' OR destination_ip = '45.3.0.2' OR alert_id = '45.3.0.2'""",
        "related_incidents": f"""SELECT incident_id, severity FROM inc WHERE incident_id IN (SELECT {_INC} FROM alerts
            WHERE destination_ip = '45.3.0.2' AND severity = 'critical')""",
        "timeline": "SELECT t_us // 1000000 AS second, count(*) AS alert_count FROM alerts GROUP BY ALL",
        "talkers": """SELECT source_ip, destination_ip, count(*) AS events, min(t_us) AS first_seen_us,
            CASE WHEN 600000000 - min(t_us) <= 600000000 THEN 'NEW' ELSE '' END AS pair_status FROM alerts
            WHERE confidence_score >= 0.85 GROUP BY source_ip, destination_ip
            ORDER BY events DESC, source_ip, destination_ip LIMIT 25""",
        "threat_distribution": """SELECT threat_class, count(*) AS alert_count FROM alerts GROUP BY ALL
            ORDER BY alert_count DESC, threat_class LIMIT 8""",
        "kill_chain": f"""SELECT source_ip, CAST(row_number() OVER (PARTITION BY source_ip ORDER BY start_us, fid) AS INTEGER) AS phase,
            model_name, threat_class, start_us, end_us, alert_count, severity, mitre_tactic, mitre_technique FROM (
            SELECT source_ip, model_name, threat_class, min(t_us) AS start_us, max(t_us) AS end_us, count(*) AS alert_count,
              {_NAME.replace('{w}', f'max({_WEIGHT})')} AS severity, any_value(mitre_tactic) AS mitre_tactic,
              any_value(mitre_technique) AS mitre_technique, min(id) AS fid FROM alerts GROUP BY source_ip, model_name, threat_class)""",
        "health": """SELECT max(t_us) AS last_event_us, CASE WHEN (43260000000 - max(t_us)) / 1000000.0 > 60 THEN 'Stale' ELSE 'Live' END AS state,
            least(100.0, count(*) / 1000.0 * 100)::DOUBLE AS alert_buffer_pct,
            least(100.0, count(DISTINCT source_ip) / 200.0 * 100)::DOUBLE AS incident_buffer_pct FROM alerts""",
        "ip_intel_fallback": f"""SELECT ip, CASE WHEN internal THEN 'Internal / RFC1918' ELSE country END AS country,
            CASE WHEN internal THEN 'N/A' ELSE asn END AS asn, CASE WHEN internal THEN 'Trusted'
              WHEN country IN ({', '.join(_q(c) for c in SUSPICIOUS_COUNTRIES)}) THEN 'Suspicious (Known Bulletproof Hoster)'
              ELSE 'Neutral' END AS reputation FROM (
            SELECT ip, {_internal('ip')} AS internal, {_list(COUNTRIES)}[m % 9 + 1] AS country, {_list(NETWORKS)}[(m % 60) // 10 + 1] AS asn FROM (
              SELECT ip, {_MD5_180.replace('{x}', 'ip')} AS m FROM (SELECT DISTINCT
                '45.' || (l_suppkey % 200)::VARCHAR || '.' || (l_partkey % 250)::VARCHAR || '.9' AS ip FROM lineitem)))""",
        "enriched_alerts": f"""SELECT id, CASE WHEN destination_ip = '45.3.0.3' THEN 'Unknown, ' || {_list(COUNTRIES)}[m % 9 + 1]
              ELSE 'Lyon, FR' END AS place,
            CASE WHEN destination_ip = '45.3.0.3' THEN {_list(NETWORKS)}[(m % 60) // 10 + 1]
              ELSE 'isp-' || substr(md5(destination_ip), 1, 4) END AS provider,
            CASE WHEN destination_ip = '45.3.0.2' OR (destination_ip = '45.3.0.3' AND {_list(COUNTRIES)}[m % 9 + 1] IN
              ({', '.join(_q(c) for c in SUSPICIOUS_COUNTRIES)})) THEN 'WARNING: Data Center / Bulletproof Hosting Detected' END AS warning
            FROM (SELECT *, {_MD5_180.replace('{x}', 'destination_ip')} AS m FROM alerts)""",
        "domain_age_alerts": f"""SELECT seq, 'RULE_DOMAIN_AGE_YOUNG' AS rule_id,
            round(0.55 + 0.40 * least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0 - age / 180.0)), 6) AS confidence, round(age, 3) AS age_days FROM (
            SELECT seq, (t_us - ({_REGISTERED})) / 86400000000::DOUBLE AS age FROM (
              SELECT seq, t_us, {_REG.replace('{x}', 'query')} AS domain FROM dns
              WHERE length(query) < 40 AND ends_with(query, '.com'))) WHERE age <= 180""",
        "playbook_render": f"""SELECT alert_id, title, {fill} AS recommended_firewall_rule, steps, checklist, mitigations,
            {_list(COUNTRIES)}[{_MD5_180.replace('{x}', 'destination_ip')} % 9 + 1] AS country FROM (
            SELECT a.*, coalesce(json_extract_string(evidence, '$.query'), 'malicious-c2.com') AS dom, t.*
            FROM alerts a LEFT JOIN aliases x ON upper(trim(a.threat_class)) = x.alias
              JOIN templates t ON t.key = coalesce(x.key, '{DEFAULT_KEY}'))""",
        "flow_assembly": """SELECT orig_h, orig_p, resp_h, resp_p, proto, orig_pkts, resp_pkts, orig_bytes, resp_bytes, duration FROM flows""",
        "packet_dns": f"""SELECT seq, CASE WHEN dns_qr = 0 THEN src_ip ELSE dst_ip END AS orig_h,
            CASE WHEN dns_qr = 0 THEN dst_ip ELSE src_ip END AS resp_h, rtrim(dns_query, '.') AS query,
            CASE WHEN dns_qr = 0 THEN {_named('dns_qtype', QTYPES)} END AS qtype_name,
            CASE WHEN dns_qr = 1 THEN {_named('dns_rcode', RCODES)} END AS rcode_name,
            CASE WHEN dns_qr = 0 THEN 'dns' ELSE 'dns_response' END AS event_type FROM packets
            WHERE dns_qr IS NOT NULL AND length <= 65535""",
        "log_parsing": """SELECT seq, t_us, orig_h, resp_p, conn_state, orig_bytes, orig_pkts FROM lines WHERE m NOT IN (7, 8)""",
        "log_rejects": """SELECT CASE WHEN m = 7 THEN '{broken' ELSE '{"seq":' || seq::VARCHAR || '}' END AS raw_payload,
            CASE WHEN m = 7 THEN 'Malformed JSON' ELSE 'Missing required fields (ts)' END AS error FROM lines WHERE m IN (7, 8)""",
        "alert_validation": """SELECT id, array_to_string(list_filter([
              CASE WHEN id % 31 = 0 THEN '''schema_version'' is a required property' END,
              CASE WHEN id % 23 = 0 THEN 'severity is not one of the allowed values' END,
              CASE WHEN id % 29 = 0 THEN 'source_ip is not a ''ip-address''' END,
              CASE WHEN id % 37 = 0 THEN 'additional properties are not allowed: metadata' END], lambda x: x IS NOT NULL), '; ') AS errors
            FROM alerts""",
        "alert_dead_letters": """SELECT 'SchemaValidationError: ' || e AS error, count(*) AS rejected FROM (
            SELECT array_to_string(list_filter([
              CASE WHEN id % 31 = 0 THEN '''schema_version'' is a required property' END,
              CASE WHEN id % 23 = 0 THEN 'severity is not one of the allowed values' END,
              CASE WHEN id % 29 = 0 THEN 'source_ip is not a ''ip-address''' END,
              CASE WHEN id % 37 = 0 THEN 'additional properties are not allowed: metadata' END], lambda x: x IS NOT NULL), '; ') AS e
            FROM alerts) WHERE e <> '' GROUP BY e""",
        "dead_letter_replay": "SELECT alert_id FROM alerts WHERE id % 7 > 1",
        "alert_upsert": """SELECT tenant_id, alert_id, CASE WHEN id % 4 = 0 THEN 'low' WHEN id % 2 = 0 THEN 'high' ELSE severity END AS severity,
            CASE WHEN id % 4 = 0 THEN id + 1000000000000 ELSE id END AS id FROM alerts WHERE id % 3 <> 0 OR id % 2 = 0""",
        "alert_table_merge": """SELECT tenant_id, alert_id, CASE WHEN id % 5 = 0 THEN 'low' WHEN id % 2 = 0 THEN 'high' ELSE severity END AS severity,
            strftime(make_timestamp(t_us), '%Y-%m-%dT%H:%M:%SZ') AS "timestamp" FROM alerts WHERE id % 3 <> 0 OR id % 2 = 0 OR id % 5 = 0""",
        "topic_roundtrip": """SELECT alert_id AS key, threat_class || '|' || severity || '|' || source_ip AS value, t_us FROM alerts""",
        "range_intel": """
          WITH r AS (
            SELECT 45 * 16777216 + p_partkey % 200 * 65536 + p_partkey % 250 * 256 AS base, 24 AS len, 'part ' || p_brand AS owner FROM part
            UNION ALL SELECT 45 * 16777216 + s_suppkey % 200 * 65536, 16, s_name FROM supplier WHERE s_suppkey % 3 <> 0
            UNION ALL SELECT 45 * 16777216 + n_nationkey * 8 * 65536, 13, n_name FROM nation),
          a AS (SELECT DISTINCT l_suppkey % 250 AS x, l_partkey % 250 AS y, l_linenumber AS z FROM lineitem),
          h AS (SELECT '45.' || x::VARCHAR || '.' || y::VARCHAR || '.' || z::VARCHAR AS ip, r.len, r.owner FROM a JOIN r
            ON r.base = (45 * 16777216 + x * 65536 + y * 256 + z) - (45 * 16777216 + x * 65536 + y * 256 + z) % (1 << (32 - r.len)))
          SELECT ip, min(owner) AS owner, len AS prefix_length FROM h
          WHERE len = (SELECT max(len) FROM h AS o WHERE o.ip = h.ip) GROUP BY ip, len""",
        "packet_dead_letters": """SELECT seq, src_ip, dst_ip, proto, length,
            CASE WHEN length IS NULL THEN 'Missing length' ELSE 'Length above 65535' END AS error
            FROM packets WHERE NOT coalesce(length <= 65535, false)""",
        "dga_gram_weights": f"WITH {_GRAM_FIT} SELECT gram, round(weight / 1e9, 6) AS weight FROM gw",
        "dga_window_max": f"WITH {_GRAM_FIT}, {_GRAM_SCORE} SELECT query, round(score, 6) AS score FROM gs",
        "dga_gate": f"""WITH {_GRAM_FIT}, {_GRAM_SCORE} SELECT seq, query, 'DL_CNN_DGA' AS rule_id, 'high' AS severity,
            round(score, 6) AS confidence FROM dns JOIN gs USING (query) WHERE score > 0.97""",
        "flow_moments": "SELECT count(*) AS n, " + ", ".join(
            [f"round(avg(x{i}), 9) AS m{i}" for i in range(5)]
            + [f"round(covar_samp(x{i}, x{j}), 9) AS c{i}{j}" for i in range(5) for j in range(i, 5)])
            + f" FROM ({_FLOW_X}) WHERE user_id % 4 <> 0",
        "flow_scores": f"WITH {_FLOW_FIT} SELECT seq, round(e, 9) AS reconstruction_mse FROM fe",
        "flow_threshold": f"""WITH {_FLOW_FIT} SELECT seq, 'DL_AUTOENCODER_FLOW_ANOMALY' AS rule_id, 'medium' AS severity,
            round(least(0.99, e / (2 * t)), 6) AS confidence FROM fe, (SELECT avg(e) + 4 * stddev_samp(e) AS t FROM fe
              WHERE user_id % 4 <> 0 AND seq % 5 = 0) WHERE e > t""",
        "tenant_backfill": """SELECT CASE WHEN tenant_id = 2 THEN 1 ELSE tenant_id END AS tenant_id, count(*) AS alert_count
            FROM alerts GROUP BY 1""",
        "triage_current": """SELECT tenant_id, incident_id, status, updated_us FROM (SELECT *, row_number() OVER (
            PARTITION BY tenant_id, incident_id ORDER BY updated_us DESC) AS r FROM triage_log WHERE status <> 'bogus') WHERE r = 1""",
        "audit_page": """SELECT updated_us AS id, 'triage.set_status' AS action, incident_id AS target, status AS detail
            FROM triage_log WHERE tenant_id = 2 AND status <> 'bogus' ORDER BY updated_us DESC LIMIT 20""",
        "confusion_by_detector": _with_metrics("detector", f"""SELECT detector, {_cells('hit', 'is_botnet')}
            FROM hit_long GROUP BY detector"""),
        "composite_evaluation": _with_metrics("scenario, 'composite' AS detector", "SELECT scenario, " + _cells(
            "risk >= 50", "is_botnet") + " FROM (SELECT scenario, is_botnet, CASE WHEN " + " OR ".join(
            f'"{n}"' for n in _CONFIDENCE) + " THEN round(100.0 / (1.0 + exp(-(" + " + ".join(
            f'CASE WHEN "{n}" THEN ' + ("ln((CASE WHEN orig_pkts > 10000 THEN 0.95 ELSE 0.85 END) / (1 - (CASE WHEN orig_pkts > 10000 "
            "THEN 0.95 ELSE 0.85 END)))" if n == "RULE_DDOS_VOLUMETRIC" else f"ln({c} / (1 - {c}))") + " ELSE 0 END"
            for n, c in _CONFIDENCE.items()) + "))), 2) ELSE 0 END AS risk FROM hits) GROUP BY scenario"),
        "composite_detectors": "WITH " + _FLOW_FIT + """,
            ft AS (SELECT avg(e) + 4 * stddev_samp(e) AS t FROM fe WHERE user_id % 4 <> 0 AND seq % 5 = 0),
            ch AS (SELECT h.*, e > t AS "DL_AUTOENCODER_FLOW_ANOMALY", least(0.99, greatest(0.01, e / (2 * t))) AS flow_conf
              FROM hits h JOIN fe USING (seq), ft),
            cr AS (SELECT *, """ + " OR ".join(f'"{n}"' for n in (*_CONFIDENCE, _FLOW)) + """ AS fires, """ + " + ".join(
                f'CASE WHEN "{n}" THEN ln({c} / (1 - {c})) ELSE 0 END' for n, c in (
                    *((n, c) for n, c in _CONFIDENCE.items() if n != "RULE_DDOS_VOLUMETRIC"),
                    ("RULE_DDOS_VOLUMETRIC", "(CASE WHEN orig_pkts > 10000 THEN 0.95 ELSE 0.85 END)"), (_FLOW, "flow_conf"))) + """ AS odds FROM ch),
            cl AS (SELECT is_botnet, 'composite' AS detector, fires AND round(100.0 / (1.0 + exp(-odds)), 2) >= 50 AS hit FROM cr
              UNION ALL SELECT is_botnet, 'any', fires FROM cr""" + "".join(
                f""" UNION ALL SELECT is_botnet, '{n}', "{n}" FROM cr""" for n in (*_CONFIDENCE, _FLOW)) + ")" + _with_metrics(
            "detector", f"SELECT detector, {_cells('hit', 'is_botnet')} FROM cl GROUP BY detector"),
        "family_gate": """WITH fg AS (SELECT kind || '-' || (user_id % 13)::VARCHAR AS family, t_us < 21600000000 AS early,
              avg((orig_bytes > 2000)::INT) AS classifier_recall, avg((orig_pkts % 3 = 0)::INT) AS rule_recall,
              avg((orig_bytes > 2000 OR orig_pkts % 3 = 0)::INT) AS combined_recall FROM conn WHERE user_id % 4 = 0 GROUP BY ALL),
            fu AS (UNPIVOT fg ON classifier_recall, rule_recall, combined_recall INTO NAME metric VALUE v)
            SELECT n.family, n.metric, round(b.v, 6) AS baseline, round(n.v, 6) AS value, round((n.v - b.v) * 100, 4) AS delta_points
            FROM fu n JOIN fu b ON n.family = b.family AND n.metric = b.metric AND b.early AND NOT n.early WHERE (n.v - b.v) * 100 < -10""",
        "threshold_sweep": _with_metrics("threshold", f"""SELECT threshold, {_cells('score > threshold', 'is_dga')} FROM (
            SELECT regexp_matches(query, '^[0-9a-v]{{24}}\\.com$') AS is_dga, label_entropy / 4.5::DOUBLE AS score,
              unnest([0.5, 0.7, 0.81, 0.85, 0.9, 0.97]::DOUBLE[]) AS threshold FROM dns_feat) GROUP BY threshold"""),
        "family_recall": """SELECT family, total, a AS classifier_caught, b AS rule_caught, c AS combined_caught,
            round(a / total::DOUBLE, 6) AS classifier_recall, round(b / total::DOUBLE, 6) AS rule_recall,
            round(c / total::DOUBLE, 6) AS combined_recall FROM (SELECT kind AS family, count(*) AS total,
              count(*) FILTER (WHERE orig_bytes > 2000) AS a, count(*) FILTER (WHERE conn_state = 'REJ') AS b,
              count(*) FILTER (WHERE orig_bytes > 2000 OR conn_state = 'REJ') AS c FROM conn WHERE user_id % 4 = 0 GROUP BY kind)""",
        "scenario_pivot": "SELECT scenario, count(*) AS total, " + ", ".join(
            f'count(*) FILTER (WHERE "{n}") AS "{n}"' for n in _CONFIDENCE) + " FROM hits WHERE is_botnet GROUP BY scenario",
        "regression_gate": "SELECT * FROM (" + " UNION ALL ".join(
            f"""SELECT detector, '{m}' AS metric, round(b."{m}", 6) AS baseline, round(n."{m}", 6) AS value,
              round((n."{m}" - b."{m}") * 100, 4) AS delta_points
            FROM ({_with_metrics('detector', f"SELECT detector, {_cells('hit', 'is_botnet')} FROM hit_long WHERE t_us >= 21600000000 GROUP BY detector", None)}) n
            JOIN ({_with_metrics('detector', f"SELECT detector, {_cells('hit', 'is_botnet')} FROM hit_long WHERE t_us < 21600000000 GROUP BY detector", None)}) b
            USING (detector) WHERE (n."{m}" - b."{m}") * 100 {'>' if m == 'fpr' else '< -'} 0.5""" for m in ("precision", "recall", "fpr")) + ")",
        "ip_normal_forms": """SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 3 = 0 AND l_orderkey % 300 < 256
              THEN '10.0.' || (l_orderkey % 300)::VARCHAR || '.1'
            WHEN l_orderkey % 3 = 1 AND l_orderkey * 17 % 65535 + 1 < 4096 THEN '2001:db8::' ||
              lower(to_hex(l_orderkey * 31 % 65535 + 1)) || ':0:0:' || lower(to_hex(l_orderkey * 17 % 65535 + 1))
            WHEN l_orderkey % 3 = 2 THEN '::ffff:10.1.2.' || (l_orderkey % 256)::VARCHAR END AS normal FROM lineitem""",
        "domain_overlap": f"""SELECT {_REG.replace('{x}', 'domain')} AS domain FROM hosts INTERSECT
            SELECT {_REG.replace('{x}', 'query')} FROM dns""",
        "leakage_free": """SELECT label, count(*) AS row_count, CAST(sum(orig_bytes) AS BIGINT) AS orig_bytes FROM (
            SELECT CASE WHEN user_id % 4 = 0 THEN 'botnet' ELSE 'normal' END AS label, orig_bytes FROM conn
              WHERE user_id % 4 = 0 OR user_id % 13 = 11
            UNION ALL SELECT 'normal', orig_bytes FROM conn WHERE user_id % 4 <> 0 AND user_id % 13 <> 11 AND seq % 5 = 0) GROUP BY label""",
    }


# n-gram weights of names and their scores, window by window.
_CUT = """flatten(list_transform({v}, lambda n: CASE WHEN length(n) > 35 THEN list_concat(
  list_transform(range(1, length(n) - 33, 15), lambda i: substr(n, i, 35)),
  CASE WHEN (length(n) - 35) % 15 <> 0 THEN [right(n, 35)] ELSE [] END) ELSE [n] END))"""
_GRAMS = """list_concat(list_transform(range(1, length({t})), lambda i: substr({t}, i, 2)),
  list_transform(range(1, length({t}) - 1), lambda i: substr({t}, i, 3)))"""
_GRAM_FIT = f"""
gl AS (SELECT DISTINCT query AS domain, 1 AS label FROM dns WHERE regexp_matches(query, '^[0-9a-v]{{24}}\\.com$')
  UNION SELECT DISTINCT domain, 0 FROM hosts WHERE domain IS NOT NULL AND domain <> ''),
gt AS (SELECT label, unnest({_CUT.replace('{v}', "[regexp_replace(lower(domain), '[^a-z0-9.-]', '-', 'g')]")}) AS text FROM gl),
gg AS (SELECT label, unnest({_GRAMS.replace('{t}', 'text')}) AS gram FROM gt),
gc AS (SELECT gram, count(*) FILTER (label = 1) AS bad, count(*) FILTER (label = 0) AS good FROM gg GROUP BY gram),
gn AS (SELECT sum(bad) AS all_bad, sum(good) AS all_good, count(*) AS kinds FROM gc),
gw AS (SELECT gram, round(ln(((bad + 1)::DOUBLE / (all_bad + kinds)) / ((good + 1)::DOUBLE / (all_good + kinds))) * 1e9)::BIGINT AS weight FROM gc, gn
  UNION ALL SELECT '', round(ln((count(*) FILTER (label = 1) + 1)::DOUBLE / (count(*) FILTER (label = 0) + 1)) * 1e9)::BIGINT FROM gt)"""
_GRAM_SCORE = f"""
gq AS (SELECT DISTINCT d.query, unnest({_CUT.replace('{v}', 'v')}) AS text FROM dns d JOIN ({_VARIANTS}) USING (seq)),
gx AS (SELECT DISTINCT text FROM gq), gy AS (SELECT text, unnest({_GRAMS.replace('{t}', 'text')}) AS gram FROM gx),
gz AS (SELECT text, sum(weight) AS total FROM gy JOIN gw USING (gram) WHERE gram <> '' GROUP BY text),
gs AS (SELECT query, 1 / (1 + exp(-(max(coalesce(total, 0)) + (SELECT weight FROM gw WHERE gram = ''))::DOUBLE / 1e9)) AS score
  FROM gq LEFT JOIN gz USING (text) GROUP BY query)"""
# Flow vectors, and the error of a model that the first three coordinates explain.
_FLOW_X = "SELECT seq, user_id, " + ", ".join(
    f"ln(1 + greatest(0, {e})::DOUBLE) / {s} AS x{i}" for i, (e, s) in enumerate([
        ("orig_bytes", 15), ("resp_bytes", 15), ("duration", 10), ("orig_pkts", 10),
        ("resp_bytes / greatest(1.0::DOUBLE, orig_bytes::DOUBLE)", 10)])) + " FROM conn"
_FLOW = "DL_AUTOENCODER_FLOW_ANOMALY"
_FLOW_FIT = f"""fx AS ({_FLOW_X}), fm AS (SELECT avg(x3) AS m3, avg(x4) AS m4 FROM fx WHERE user_id % 4 <> 0 AND seq % 5 <> 0),
fe AS (SELECT seq, user_id, ((x3 - m3) ** 2 + (x4 - m4) ** 2) / 5 AS e FROM fx, fm)"""


def statements() -> dict[str, str]:
    """SQL per registered query; the queries of trained Spark ML models have none."""
    out = {name: _sql(body) for name, body in _bodies().items()}
    kept = "(SELECT * FROM feed WHERE alert_id NOT IN (SELECT alert_id FROM feed WHERE model_name = 'RULE_RECON_PORT_SCAN'))"
    out["correlation_triggers"] = _correlation(
        "feed", "SELECT source_ip, anchor, n, alert_id, safe_class FROM corr_state WHERE trig")
    out["correlation_rollback"] = _correlation(
        kept, "SELECT source_ip, anchor, count(*) AS counted, count(*) FILTER (WHERE trig) AS triggers "
        "FROM corr_state GROUP BY ALL")
    out["correlated_incidents"] = _correlation("feed", f""",
  snap AS (SELECT t.source_ip, t.anchor, t.n AS trigger_n, t.t_us AS created_us, e.model_name, e.weight, e.threat_class,
      e.destination_ip, e.mitre_tactic, e.alert_id, e.confidence_score, e.n > t.n - 100 AS newest FROM corr_state t JOIN corr_state e
    ON t.source_ip = e.source_ip AND t.anchor = e.anchor AND e.n <= t.n WHERE t.trig),
  snap_risk AS (SELECT source_ip, anchor, trigger_n, {_POOL.replace('{d}', '2')} AS risk FROM (
    SELECT source_ip, anchor, trigger_n, model_name, max({_CONF}) AS best FROM snap GROUP BY ALL) GROUP BY ALL)
SELECT 'INC-' || upper(substr(md5(source_ip || '|' || anchor::VARCHAR || '|' || trigger_n::VARCHAR), 1, 8)) AS incident_id,
  source_ip, anchor, trigger_n, max(created_us) AS created_us, {_NAME.replace('{w}', 'max(weight)')} AS severity,
  round(any_value(risk), 1) AS risk_score, count(*) AS alert_count,
  len(list_distinct(list_append(list(destination_ip), source_ip)))::BIGINT AS entity_count,
  string_agg(DISTINCT threat_class, ',' ORDER BY threat_class) AS threat_classes,
  array_to_string(list_sort(list_distinct(list_append(list(destination_ip) FILTER (newest), source_ip))), ',') AS affected_entities,
  string_agg(DISTINCT mitre_tactic, ',' ORDER BY mitre_tactic) AS tactics,
  string_agg(DISTINCT alert_id, ',' ORDER BY alert_id) FILTER (newest) AS related_alert_ids
FROM snap JOIN snap_risk USING (source_ip, anchor, trigger_n) WHERE risk >= 50 GROUP BY source_ip, anchor, trigger_n""")
    return out
