"""Personal data by patterns and by bootstrapped contexts.

1. *Seeds.* Emails, addresses, card and phone numbers of fixed forms are found in every text. A text is split
   at the matches of a form, so the lengths of pieces and matches give all positions.
2. *Mentions.* Seeds and all other words with a digit or an at sign are mentions: a value, and as its lexical pattern the two
   words before it.
3. *Graph.* Mentions link patterns with values. Round by round, a pattern's confidence for a kind is the share of its
   mentions whose value is believed to be of that kind, and a value that no form covers is believed as far as
   its confident patterns say so. Seeds are certain. Every round is a join and two sums over the distinct links, with map-side
   combine; a pattern that stands before a third of all mentions is one row of sums.
4. *Discovery.* Mentions of values with enough confidence become further spans.

Only functions of Spark run here. Texts are read once; later steps see mentions, not texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hawkgrid.functions.bind import let
from hawkgrid.llm.common import key_of
from hawkgrid.session import durable

KINDS = ["email", "ip", "card", "phone"]
ROUNDS, MIN_SEEDS, SMOOTHING, MIN_PATTERN, MIN_VALUE = 3, 3, 1.0, 0.8, 0.8
_LOCAL = "A-Za-z0-9._%+-"
# The forms, written so that no text makes them slow or deep: runs are taken whole and never tried again from their middle.
FORMS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HINTS = {"email": "@", "phone": "+"}
_MENTION = r"(?<![^\s])[^\s]*?[0-9@][^\s]*"
_ENDS = r"\"')>\]},;:.!?"
_EDGES_LEFT, _EDGES_RIGHT = r"^[\"'(<\[{]+", rf"(?<![{_ENDS}])[{_ENDS}]++$"
_CONTEXT = 80
_FOUND = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    numbers = F.transform(F.split(F.reverse(digits), ""), lambda d: d.try_cast("int"))
    doubled = F.transform(numbers, lambda d, k: F.when(k % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.coalesce(plain(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _places(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern, left to right, with their places in code points."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(_FOUND)
    steps = F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p")))
    found = F.aggregate(
        F.filter(steps, lambda s: s["m"].isNotNull()), F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda acc, s: F.struct(
            (acc["at"] + F.length(s["p"]) + F.length(s["m"])).alias("at"),
            F.concat(acc["found"], F.array(F.struct(
                F.lit(kind).alias("kind"), (acc["at"] + F.length(s["p"])).alias("start"),
                (acc["at"] + F.length(s["p"]) + F.length(s["m"])).alias("end"), s["m"].alias("value")))).alias("found")),
        lambda acc: acc["found"])
    return found


def _base(kind: str) -> Column:
    text = F.col("_t")
    hint = F.contains(text, F.lit(_HINTS[kind])) if kind in _HINTS else text.rlike("[0-9]")
    found = F.filter(_places(text, FORMS[kind], KINDS.index(kind)), lambda s: _valid(kind, s["value"]))
    return F.when(hint, found).otherwise(F.array().cast(_FOUND))


def _context(start: Column) -> Column:
    """The two words before a place, lower-cased; of longer words the last part within ``_CONTEXT`` characters."""
    left = F.substring(F.col("_t"), F.greatest(start - _CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(_CONTEXT)))
    return F.lower(F.regexp_extract(left, r"((?:[^\s]+\s+)?[^\s]+\s*)$", 1))


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc, row, doc_id, base (spans of the fixed forms), mentions (kind -1 for values of no form)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", key_of().alias("doc"), F.xxhash64("text").alias("row"), text.alias("_t"))
    rows = rows.select("doc_id", "doc", "row", "_t", F.concat(*[_base(k) for k in KINDS]).alias("base"))
    rough = F.when(F.col("_t").rlike("[0-9@]"), _places(F.col("_t"), _MENTION, -1)).otherwise(F.array().cast(_FOUND))

    def trimmed(s: Column) -> Column:
        cut = F.regexp_replace(s["value"], _EDGES_LEFT, "")
        start = s["start"] + F.length(s["value"]) - F.length(cut)
        return let(F.struct(start.alias("start"), F.regexp_replace(cut, _EDGES_RIGHT, "").alias("value")), lambda x: F.struct(
            F.lit(-1).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))

    apart = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = rows.withColumn("_rough", F.filter(F.transform(rough, trimmed), lambda s: (s["end"] > s["start"]) & apart(s)))
    mentions = F.transform(F.concat("base", "_rough"), lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"),
        F.trim(_context(s["start"])).alias("pattern")))
    return rows.select("doc_id", "doc", "row", "base", mentions.alias("mentions"))


def _fits(kind: Column, value: Column) -> Column:
    """Whether a value of no form can stand for a kind at all."""
    return F.when(kind == 0, F.contains(value, F.lit("@"))).when(
        kind == 1, F.length(F.regexp_replace(value, "[^.:]", "")) >= 3).otherwise(F.length(_digits(value)) >= 4)


def believe(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, confidence) of values of no form, from links (pattern, value, kind, n).

    ``kind`` is the seed's kind, or -1. A pattern counts for a kind with at least ``MIN_SEEDS`` distinct values of it.
    """
    weight = links.groupBy("pattern").agg(F.sum("n").alias("total"))
    open_links = links.where("kind = -1").select("pattern", "value", "n")
    seeds = links.where("kind >= 0").select("pattern", "value", "kind", "n", F.lit(1.0).alias("confidence"))
    empty = seeds.where("false").select("value", "kind", "confidence")
    values = None
    for _ in range(rounds):
        known = seeds if values is None else seeds.unionByName(
            open_links.join(values, "value").select("pattern", "value", "kind", "n", "confidence"))
        patterns = (
            known.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("confidence")).alias("sure"), F.count("value").alias("values"))
            .where(F.col("values") >= MIN_SEEDS).join(weight, "pattern")
            .select("pattern", "kind", (F.col("sure") / (F.col("total") + SMOOTHING)).alias("p")).where(F.col("p") >= MIN_PATTERN))
        # Independent patterns: a value is doubted only if all of them are wrong.
        values = (
            open_links.join(patterns, "pattern").where(_fits(F.col("kind"), F.col("value")))
            .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999)))))).alias("confidence")))
        values = durable(values)
    return values if values is not None else empty


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts and text of the base spans, and of all spans.

    doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and discovered, as kind:start:end), n_found
    (discovered). Places are code points, ends exclusive. A null text counts as empty. Base spans of a kind do not
    overlap; discovered ones lie apart from all base spans. Repeated rows give the same result each; rows without an
    id are told apart by their text. Other columns are ignored.
    """
    found = durable(find(docs))
    mentions = found.select("doc", "row", F.explode("mentions").alias("m")).select("doc", "row", "m.*")
    links = durable(mentions.where("pattern <> ''").groupBy("pattern", "value", "kind").agg(F.count("*").alias("n")))
    values = believe(links, rounds)
    # Of several kinds, the likeliest; of equal ones, the first.
    best = values.where(F.col("confidence") >= MIN_VALUE).withColumn("_k", F.row_number().over(
        Window.partitionBy("value").orderBy(F.desc("confidence"), "kind"))).where("_k = 1").select("value", F.col("kind").alias("as_kind"))
    fresh = (
        mentions.where("kind = -1 and pattern <> ''").join(best, "value")
        .groupBy("doc", "row").agg(F.collect_set(F.struct(F.col("as_kind").alias("kind"), "start", "end")).alias("fresh")))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    joined = found.drop("mentions").join(fresh, ["doc", "row"], "left")
    base = F.sort_array(plain(F.col("base")))
    more = F.coalesce("fresh", F.array().cast("array<struct<kind:int,start:int,end:int>>"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return joined.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_text(base), 256).alias("base_sha256"), _text(F.sort_array(F.concat(base, more))).alias("spans"),
        F.size(more).cast("long").alias("n_found"))
