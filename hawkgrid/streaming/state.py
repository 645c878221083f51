"""Keyed state for streams: trailing windows per pair, DNS sessions and correlation per source.

Processors for ``transformWithStateInPandas`` on the RocksDB state store. Nothing is capped:

* A pair's connections lie in time slots. A slot's summary (count, bytes, squares of gaps) stands for its rows wherever a
  window covers the whole slot; rows, packed, are read only for slots in which a new row or the edge of one of its windows
  lies, and written only for slots that get new rows.
* Names, entities and alert ids are sets of 128-bit digests in buckets; a batch reads and writes the buckets of its own
  values. A set belongs to one session or window, and one of a new session replaces it bucket by bucket.
* State that no later row can need is removed by event-time timers.

Rows of a key are taken in (t_us, seq) order inside a micro-batch, with numpy over all of them; the micro-batch bounds what is
gathered for a key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from hawkgrid.functions.net import normalise_ip
from hawkgrid.functions.parse import safe_int
from hawkgrid.operators.correlate import LISTED, REPEAT_EVERY, prepare

SECOND = 1_000_000
SLOT_US = 60 * SECOND
_UNIT = 10**12
_BUCKETS = 256

_CONN_OUT = (
    "source_ip string, destination_ip string, t_us long, seq long, trace_id string, event_time timestamp, connection_count long, "
    "total_bytes long, observations long, mean_interval_seconds double, coefficient_of_variation double, "
    "is_flood boolean, is_exfil boolean, is_beacon boolean"
)
_DNS_OUT = (
    "source_ip string, t_us long, seq long, trace_id string, event_time timestamp, query string, distinct_domains long, "
    "total_responses long, nxdomain_responses long, nxdomain_rate double, reason string"
)
_INCIDENT_OUT = (
    "incident_id string, source_ip string, anchor long, trigger_n long, created_us long, trace_id string, event_time timestamp, "
    "severity string, risk_score double, threat_classes array<string>, affected_entities array<string>, tactics array<string>, "
    "related_alert_ids array<string>, alert_count long, entity_count long, status string"
)
# Names of the severity weights.
_SEVERITIES = {100.0: "critical", 75.0: "high", 50.0: "medium"}


def use_state_store(spark: SparkSession) -> None:
    """Processors with typed state need the RocksDB state store; a runtime setting of the session."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _with_event_time(rows: DataFrame, delay: str) -> DataFrame:
    if "event_time" in rows.columns:
        # Rows of an earlier stateful step bring their watermark along.
        return rows
    return rows.withColumn("event_time", F.timestamp_micros("t_us")).withWatermark("event_time", delay)


def _trace(rows: DataFrame) -> Column:
    return (F.col("trace_id") if "trace_id" in rows.columns else F.lit(None).cast("string")).alias("trace_id")


def _carried(rows: DataFrame) -> list[str]:
    return ["event_time"] if "event_time" in rows.columns else []


def _gather(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable", ignore_index=True)


def _times(t: np.ndarray) -> np.ndarray:
    return t.astype("datetime64[us]")


class PackedSet:
    """Digests of texts in buckets of a map state; all of one ``epoch`` (a session or window), older ones count as gone."""

    def __init__(self, handle, name: str):
        self.state = handle.getMapState(name, "bucket int", "epoch long, digests binary")

    def add(self, values: list[str], epoch: int) -> np.ndarray:
        """Add texts (all different); tells which ones were new."""
        digests = [hashlib.blake2b(v.encode(), digest_size=16).digest() for v in values]
        new = np.zeros(len(values), bool)
        by_bucket: dict[int, list[int]] = {}
        for k, d in enumerate(digests):
            by_bucket.setdefault(d[0] % _BUCKETS, []).append(k)
        for bucket, places in by_bucket.items():
            held = self.state.getValue((bucket,)) if self.state.containsKey((bucket,)) else None
            raw = bytes(held[1]) if held is not None and held[0] == epoch else b""
            known = {raw[k:k + 16] for k in range(0, len(raw), 16)}
            fresh = [k for k in places if digests[k] not in known]
            new[fresh] = True
            if fresh or not raw:
                self.state.updateValue((bucket,), (epoch, raw + b"".join(digests[k] for k in fresh)))
        return new

    def clear(self) -> None:
        self.state.clear()


class ConnProcessor(StatefulProcessor):
    """Window statistics of one pair right after each of its connections."""

    def __init__(self, rate, volume, beacon, rate_min, bytes_min, min_obs, max_cv, min_interval, slot_us):
        self.windows = (rate, volume, beacon)
        self.limits = (rate_min, bytes_min, min_obs, max_cv, min_interval)
        self.slot = slot_us

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "slot long", "t binary, b binary, s binary")
        self.facts = handle.getMapState("facts", "slot long", "n long, bytes long, first long, last long, squares double")

    def _load(self, slot: int) -> list[np.ndarray]:
        return [np.frombuffer(bytes(x), "<i8") for x in self.rows.getValue((slot,))]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = _gather(rows, ["t_us", "seq"])
        t, b, s = (fresh[c].to_numpy("int64") for c in ("t_us", "bytes", "seq"))
        facts = {k[0]: tuple(v) for k, v in self.facts.iterator()}
        own = t // self.slot
        edges = [(t - w) // self.slot for w in self.windows]
        new_slots = np.unique(own)
        wanted = np.union1d(new_slots, np.unique(np.concatenate(edges)))
        parts = {k: [*self._load(k), np.zeros(facts[k][0], bool)] for k in wanted.tolist() if k in facts}
        for k in new_slots.tolist():
            low, high = np.searchsorted(own, [k, k + 1])
            added = [t[low:high], b[low:high], s[low:high], np.ones(high - low, bool)]
            joined = [np.concatenate(p) for p in zip(parts[k], added, strict=True)] if k in parts else added
            order = np.lexsort((joined[2], joined[0]))
            parts[k] = [p[order] for p in joined]
        # The pair's time line: rows where they are needed, one entry per slot elsewhere.
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for k in sorted(facts.keys() | parts.keys()):
            if k in parts:
                pt, pb, ps, pf = parts[k]
                entry = (pt, pt, np.ones(len(pt), np.int64), pb, np.zeros(len(pt)), ps, pf)
            else:
                n, total, first, last, squares = facts[k]
                entry = tuple(np.array([v]) for v in (first, last, n, total, squares, 0, False))
            for column, values in zip(columns, entry, strict=True):
                column.append(values)
        first, last, n, total, squares, seq, is_new = (np.concatenate(c) for c in columns)
        gap = np.zeros(len(first))
        gap[1:] = (first[1:] - last[:-1]) / 1e6
        upto = [np.concatenate([[0], np.cumsum(x)]) for x in (n, total, squares + gap * gap)]
        at = np.flatnonzero(is_new)
        now = first[at]
        since = [np.searchsorted(first, now - w, side) for w, side in zip(self.windows, ("left", "left", "right"), strict=True)]
        count = upto[0][at + 1] - upto[0][since[0]]
        volume = upto[1][at + 1] - upto[1][since[1]]
        low = since[2]
        seen = upto[0][at + 1] - upto[0][low]
        k = seen - 1
        rate_min, bytes_min, min_obs, max_cv, min_interval = self.limits
        with np.errstate(divide="ignore", invalid="ignore"):
            span = (now - first[low]) / 1e6
            mean = np.where(k > 0, span / k, np.nan)
            # The gap into the window's first row is not part of the window.
            inside = upto[2][at + 1] - upto[2][low] - gap[low] ** 2
            cv = np.where((k >= 2) & (span > 0), np.sqrt(np.maximum((inside - span * span / k) / (k - 1), 0)) / mean, np.nan)
            regular = (seen >= min_obs) & (mean >= min_interval) & (cv <= max_cv)
        for slot in new_slots.tolist():
            pt, pb, ps, _ = parts[slot]
            self.rows.updateValue((slot,), tuple(x.astype("<i8").tobytes() for x in (pt, pb, ps)))
            inner = np.diff(pt) / 1e6
            self.facts.updateValue((slot,), (len(pt), int(pb.sum()), int(pt[0]), int(pt[-1]), float((inner * inner).sum())))
        self._evict(facts, timerValues)
        self.handle.registerTimer(int(((own[-1] + 1) * self.slot + max(self.windows)) // 1000 + 1))
        trace = dict(zip(zip(t.tolist(), s.tolist(), strict=True), fresh["trace_id"], strict=True))
        yield pd.DataFrame({
            "source_ip": key[0], "destination_ip": key[1], "t_us": now, "seq": seq[at],
            "trace_id": [trace[p] for p in zip(now.tolist(), seq[at].tolist(), strict=True)], "event_time": _times(now),
            "connection_count": count, "total_bytes": volume, "observations": seen, "mean_interval_seconds": mean,
            "coefficient_of_variation": cv, "is_flood": count >= rate_min, "is_exfil": volume >= bytes_min, "is_beacon": regular})

    def _evict(self, facts: dict, timerValues) -> None:
        # No later row is older than the watermark, so no window reaches further back than this.
        bound = timerValues.getCurrentWatermarkInMs() * 1000 - max(self.windows)
        for slot in facts:
            if (slot + 1) * self.slot <= bound:
                self.rows.removeKey((slot,))
                self.facts.removeKey((slot,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._evict({k[0]: None for k in self.facts.keys()}, timerValues)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_conn_windows(
    conn: DataFrame, rate_window_s: float = 10.0, rate_min_count: int = 1000, bytes_window_s: float = 600.0,
    bytes_min_total: int = 1_000_000, beacon_window_s: float = 21600.0, beacon_min_observations: int = 3,
    beacon_max_cv: float = 0.5, beacon_min_interval_s: float = 5.0, delay: str = "10 minutes", slot_us: int = SLOT_US,
) -> DataFrame:
    """Streaming form of ``conn_windows``: all connections of a pair count, however many.

    The state holds 24 bytes per connection of the longest window and a summary per slot; each connection needs ``seq``
    unique. ``trace_id`` is passed on.
    """
    use_state_store(conn.sparkSession)
    rows = conn.select(
        normalise_ip("orig_h").alias("source_ip"), normalise_ip("resp_h").alias("destination_ip"), "t_us", "seq",
        F.greatest(F.coalesce(F.col("orig_bytes"), F.lit(0)), F.lit(0)).cast("bigint").alias("bytes"), _trace(conn), *_carried(conn),
    ).where("source_ip is not null and destination_ip is not null and t_us is not null")
    windows = [int(w * SECOND) for w in (rate_window_s, bytes_window_s, beacon_window_s)]
    processor = ConnProcessor(*windows, rate_min_count, bytes_min_total, beacon_min_observations, beacon_max_cv,
                              beacon_min_interval_s, slot_us)
    return _with_event_time(rows, delay).groupBy("source_ip", "destination_ip").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(_CONN_OUT), outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time")


def _running(times: np.ndarray, gap: int, count: int, last: int | None) -> np.ndarray:
    """A counter at each time that starts again after a silence longer than ``gap``; continues ``count`` at ``last``."""
    if not len(times):
        return np.zeros(0, np.int64)
    opens = np.append(last is None or times[0] - last > gap, np.diff(times) > gap)
    here = np.arange(len(times))
    start = np.maximum.accumulate(np.where(opens, here, -1))
    return np.where(start < 0, here + 1 + count, here - start + 1)


class DnsProcessor(StatefulProcessor):
    """Session counters of one source at each of its queries."""

    def __init__(self, gap, distinct_min, responses_min, rate_min):
        self.gap, self.limits = gap, (distinct_min, responses_min, rate_min)

    def init(self, handle) -> None:
        self.handle = handle
        self.counters = handle.getValueState(
            "counters", "session long, names long, name_t long, total long, total_t long, nx long, nx_t long")
        self.names = PackedSet(handle, "names")

    def _responses(self, times: np.ndarray, before: np.ndarray, at: np.ndarray, count: int, last: int | None):
        """The counter as of each query: ``before`` responses of the batch come first; and its new state."""
        run = _running(times, self.gap, count, last)
        values, ends = np.append(count, run), np.append(-(2**62) if last is None else last, times)
        alive = at - ends[before] <= self.gap
        return np.where(alive, values[before], 0), (int(values[-1]), None if len(times) == 0 and last is None else int(ends[-1]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = _gather(rows, ["t_us", "seq", "kind"])
        session, names, name_t, total, total_t, nx, nx_t = self.counters.get() if self.counters.exists() else (0, 0, None, 0, None, 0, None)
        t, kind, is_nx = (rows[c].to_numpy("int64") for c in ("t_us", "kind", "nx"))
        asked = np.flatnonzero(kind == 0)
        now = t[asked]
        answers, failed = np.flatnonzero(kind == 1), np.flatnonzero((kind == 1) & (is_nx == 1))
        responses, (total, total_t) = self._responses(t[answers], np.searchsorted(answers, asked), now, total, total_t)
        failures, (nx, nx_t) = self._responses(t[failed], np.searchsorted(failed, asked), now, nx, nx_t)
        if len(asked):
            opens = np.append(name_t is None or now[0] - name_t > self.gap, np.diff(now) > self.gap)
            sessions = session + np.cumsum(opens)
            queries = rows["query"].to_numpy()[asked]
            first = ~pd.DataFrame({"s": sessions, "q": queries}).duplicated().to_numpy()
            # Only a continued session can know a name already, and only the last one goes on after the batch.
            for number in {session, int(sessions[-1])}:
                places = np.flatnonzero(first & (sessions == number))
                if len(places):
                    known = ~self.names.add(queries[places].tolist(), number)
                    first[places[known]] = False
            running = np.cumsum(first)
            starts = np.maximum.accumulate(np.where(opens, np.arange(len(now)), -1))
            distinct = np.where(starts < 0, names + running, running - np.where(starts > 0, running[starts - 1], 0))
            session, names, name_t = int(sessions[-1]), int(distinct[-1]), int(now[-1])
            with np.errstate(divide="ignore", invalid="ignore"):
                rate = np.where(responses > 0, failures / responses, 0.0)
            distinct_min, responses_min, rate_min = self.limits
            reason = np.where(distinct >= distinct_min, "distinct_domain_burst", np.where(
                (responses >= responses_min) & (rate >= rate_min), "high_nxdomain_rate", None))
            yield pd.DataFrame({
                "source_ip": key[0], "t_us": now, "seq": rows["seq"].to_numpy("int64")[asked], "trace_id": rows["trace_id"].to_numpy()[asked],
                "event_time": _times(now), "query": queries, "distinct_domains": distinct, "total_responses": responses,
                "nxdomain_responses": failures, "nxdomain_rate": rate, "reason": reason})
        self.counters.update((session, names, name_t, total, total_t, nx, nx_t))
        latest = max(x for x in (name_t, total_t) if x is not None)
        self.handle.registerTimer(int((latest + self.gap) // 1000 + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.counters.exists():
            state = self.counters.get()
            latest = max(x for x in (state[2], state[4]) if x is not None)
            if latest + self.gap < timerValues.getCurrentWatermarkInMs() * 1000:
                self.counters.clear()
                self.names.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_dns_windows(
    dns: DataFrame, window_s: float = 60.0, distinct_min: int = 40, responses_min: int = 8,
    nxdomain_rate: float = 0.5, delay: str = "10 minutes",
) -> DataFrame:
    """Streaming form of ``dns_windows``: all names of a session count."""
    use_state_store(dns.sparkSession)
    is_query = F.col("event_type") == "dns"
    rows = dns.where(F.col("event_type").isin("dns", "dns_response")).select(
        normalise_ip("orig_h").alias("source_ip"), "t_us", "seq", (~is_query).cast("int").alias("kind"),
        F.when(is_query, F.trim("query")).alias("query"),
        (~is_query & (safe_int(F.col("rcode")) == 3)).cast("int").alias("nx"), _trace(dns), *_carried(dns),
    ).where(F.col("source_ip").isNotNull() & F.col("t_us").isNotNull() & ((F.col("kind") == 1) | (F.length("query") > 0)))
    processor = DnsProcessor(int(window_s * SECOND), distinct_min, responses_min, nxdomain_rate)
    return _with_event_time(rows, delay).groupBy("source_ip").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=StructType.fromDDL(_DNS_OUT), outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time")


class IncidentProcessor(StatefulProcessor):
    """Anchored windows, triggers and incidents of one source."""

    def __init__(self, length, min_risk, listed):
        self.length, self.min_risk, self.listed = length, min_risk, listed

    def init(self, handle) -> None:
        self.handle = handle
        self.window = handle.getValueState(
            "window", "anchor long, n long, pooled long, weight double, entities long, ids array<string>, tos array<string>")
        # Short vocabularies: one entry each, with the window they belong to.
        self.detectors = handle.getMapState("detectors", "name string", "anchor long, odds long")
        self.vocabulary = handle.getMapState("vocabulary", "kind string, value string", "anchor long")
        self.classes = handle.getMapState("classes", "name string", "opened long, highest double")
        self.seen, self.entities = PackedSet(handle, "seen"), PackedSet(handle, "entities")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Alerts of one event share its time and number.
        rows = _gather(rows, ["t_us", "seq", "alert_id"])
        held = self.window.get() if self.window.exists() else None
        t = rows["t_us"].to_numpy("int64")
        # Each alert's window: a few steps, one per window that opens.
        low, parts = 0, []
        anchor = None if held is None else held[0]
        while low < len(t):
            if anchor is None or t[low] - anchor > self.length:
                anchor = int(t[low])
            high = max(int(np.searchsorted(t, anchor + self.length, "right")), low + 1)
            parts.append((anchor, self._counted(rows.iloc[low:high], anchor)))
            low = high
        found = pd.concat([p for _, p in parts], ignore_index=True)
        recorded = self._recorded(found)
        done = 0
        for anchor, part in parts:
            state = held if held is not None and held[0] == anchor else (anchor, 0, 0, 0.0, 0, [], [])
            held, out = self._build(key[0], part.reset_index(drop=True), recorded[done:done + len(part)], anchor, state)
            done += len(part)
            if len(out):
                yield out
        self.window.update(held)
        self.handle.registerTimer(int((t[-1] + self.length) // 1000 + 1))

    def _counted(self, rows: pd.DataFrame, anchor: int) -> pd.DataFrame:
        """First of each id, replays, and alerts without an id."""
        named = rows["alert_id"].notna() & (rows["alert_id"] != "")
        first = named & ~rows["alert_id"].duplicated()
        places = np.flatnonzero(first.to_numpy())
        new = self.seen.add(rows["alert_id"].to_numpy()[places].tolist(), anchor)
        keep = (~named | rows["is_replay"].astype(bool)).to_numpy()
        keep[places[new]] = True
        return rows[keep]

    def _recorded(self, rows: pd.DataFrame) -> np.ndarray:
        """The highest severity recorded before each alert in its class's own window."""
        out = np.zeros(len(rows))
        t, weight = rows["t_us"].to_numpy("int64"), rows["weight"].to_numpy("float64")
        for name, places in rows.groupby("safe_class", sort=False).indices.items():
            opened, highest = self.classes.getValue((name,)) if self.classes.containsKey((name,)) else (None, 0.0)
            low = 0
            while low < len(places):
                if opened is None or t[places[low]] - opened > self.length:
                    opened, highest = int(t[places[low]]), 0.0
                high = max(int(np.searchsorted(t[places], opened + self.length, "right")), low + 1)
                some = places[low:high]
                running = np.maximum.accumulate(np.append(highest, weight[some]))
                out[some], highest, low = running[:-1], float(running[-1]), high
            self.classes.updateValue((name,), (opened, highest))
        return out

    def _so_far(self, kind: str, values: pd.Series, anchor: int) -> list[tuple[str, int]]:
        """Values of the window with the place in this batch at which each is first met (-1: before it)."""
        firsts = {v: k for k, v in reversed(list(enumerate(values))) if v}
        known = {k[1] for k, v in self.vocabulary.iterator() if k[0] == kind and v[0] == anchor}
        for value in firsts.keys() - known:
            self.vocabulary.updateValue((kind, value), (anchor,))
        return [*((v, -1) for v in known), *((v, k) for v, k in firsts.items() if v not in known)]

    def _build(self, source: str, rows: pd.DataFrame, recorded: np.ndarray, anchor: int, state: tuple):
        _, n0, pooled0, weight0, entities0, ids0, tos0 = state
        if not len(rows):
            return tuple(state), pd.DataFrame()
        n = n0 + 1 + np.arange(len(rows))
        weight = rows["weight"].to_numpy("float64")
        trigger = (n >= 2) & ((recorded == 0) | (weight > recorded) | (n == 2) | (n % REPEAT_EVERY == 0))
        p = rows["confidence"].to_numpy("float64")
        odds = np.round(np.log(p / (1 - p)) * _UNIT).astype(np.int64)
        gained = np.zeros(len(rows), np.int64)
        for name, places in rows.groupby("detector", sort=False).indices.items():
            stored = self.detectors.getValue((name,)) if self.detectors.containsKey((name,)) else None
            before = stored[1] if stored is not None and stored[0] == anchor else None
            if before is None:
                running = np.maximum.accumulate(odds[places])
                gained[places] = np.diff(running, prepend=0)
            else:
                running = np.maximum.accumulate(np.append(before, odds[places]))
                gained[places] = np.diff(running)
            self.detectors.updateValue((name,), (anchor, int(running[-1])))
        pooled = pooled0 + np.cumsum(gained)
        top = np.maximum.accumulate(np.append(weight0, weight))[1:]
        to = rows["destination_ip"].where(rows["destination_ip"].notna(), None)
        first = (to.notna() & (to != "") & ~to.duplicated()).to_numpy().copy()
        places = np.flatnonzero(first)
        first[places[~self.entities.add(to.to_numpy()[places].tolist(), anchor)]] = False
        # The source is an entity of its own; as a destination it does not count again.
        entities = entities0 + np.cumsum(first & (to != source).to_numpy())
        classes = self._so_far("class", rows["threat_class"], anchor)
        tactics = self._so_far("tactic", rows["mitre_tactic"], anchor)
        ids, tos = [*ids0, *rows["alert_id"].where(rows["alert_id"].notna(), None)], [*tos0, *to]
        risk = np.round(100 / (1 + np.exp(-pooled / _UNIT)), 2)
        created, traces, past = rows["t_us"].to_numpy("int64"), rows["trace_id"].to_numpy(), len(ids0)
        out = []
        for k in np.flatnonzero(trigger & (risk >= self.min_risk)).tolist():
            newest = slice(max(0, past + k + 1 - self.listed), past + k + 1)
            label = hashlib.md5(f"{source}|{anchor}|{n[k]}".encode(), usedforsecurity=False).hexdigest()
            out.append((
                "INC-" + label[:8].upper(), source, anchor, int(n[k]), int(created[k]), traces[k], _times(created[k:k + 1])[0],
                _SEVERITIES.get(float(top[k]), "low"), float(risk[k]), sorted(v for v, at in classes if at <= k) or ["unknown"],
                sorted({source, *(x for x in tos[newest] if x)}), sorted(v for v, at in tactics if at <= k),
                sorted({x for x in ids[newest] if x}), int(n[k]), int(entities[k]) + 1, "active"))
        names = [c.split()[0] for c in _INCIDENT_OUT.split(", ")]
        kept = (anchor, int(n[-1]), int(pooled[-1]), float(top[-1]), int(entities[-1]), ids[-self.listed:], tos[-self.listed:])
        return kept, pd.DataFrame(out, columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = timerValues.getCurrentWatermarkInMs() * 1000 - self.length
        if self.window.exists() and self.window.get()[0] < bound:
            for part in (self.window, self.detectors, self.vocabulary, self.seen, self.entities):
                part.clear()
        for name in [k[0] for k, v in self.classes.iterator() if v[0] < bound]:
            self.classes.removeKey((name,))
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def stream_incidents(
    alerts: DataFrame, window_s: float = 300.0, min_risk: float = 50.0, delay: str = "10 minutes", listed: int = LISTED
) -> DataFrame:
    """Streaming form of ``correlated_incidents``; all alerts of a window count, lists name the newest ``listed``."""
    from hawkgrid.functions.severity import effective_confidence

    use_state_store(alerts.sparkSession)
    rows = prepare(alerts, ("trace_id", "event_time")).withColumn(
        "confidence", effective_confidence(F.col("confidence_score"), F.col("severity"))).drop("confidence_score")
    rows = rows.withColumn("trace_id", _trace(rows))
    return _with_event_time(rows, delay).groupBy("source_ip").transformWithStateInPandas(
        statefulProcessor=IncidentProcessor(int(window_s * SECOND), min_risk, listed),
        outputStructType=StructType.fromDDL(_INCIDENT_OUT), outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time")
