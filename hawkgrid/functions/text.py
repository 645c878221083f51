"""Domain-name features: entropy, lexical shape, variants and character windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hawkgrid.functions.bind import let

# Suffixes of content networks and clouds whose hashed host names
# are ordinary traffic. Matched at the end of the name, without a dot boundary.
KNOWN_INFRA_SUFFIXES = [
    "cloudfront.net",
    "amazonaws.com",
    "akamaized.net",
    "akamaiedge.net",
    "akamai.net",
    "fastly.net",
    "sharepoint.com",
    "gravatar.com",
    "googleusercontent.com",
    "googleapis.com",
    "windows.net",
    "azureedge.net",
    "cloudflare.com",
    "github.io",
    "githubusercontent.com",
]
# Fixed values of the lexical vector and the character windows.
LEXICAL_NAMES = ["length", "entropy", "digits", "vowels", "distinct", "consonant_run", "hyphens"]
MAX_LABEL, MAX_ENTROPY, MAX_RUN = 63.0, 5.25, 10.0
WINDOW, STEP, MIN_LABEL = 35, 15, 4
_LABEL = "^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"


def count_matching(text: Column, char_class: str) -> Column:
    """How many characters of ``text`` lie in the regex class."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]", ""))


def _characters(text: Column) -> Column:
    return F.array_distinct(F.split(text, ""))


def shannon_entropy(text: Column) -> Column:
    """Entropy of the character distribution in bits; 0 for empty or null text.

    log2(n) minus the mean of log2(count) over all characters.
    """

    def entropy(t: Column) -> Column:
        n = F.length(t)
        counts = F.transform(_characters(t), lambda c: n - F.length(F.replace(t, c)))
        weighted = F.aggregate(
            counts, F.lit(0.0), lambda total, k: total + F.when(k > 1, k * F.log2(k)).otherwise(F.lit(0.0)))
        return F.when(n > 0, F.greatest(F.log2(n) - weighted / n, F.lit(0.0))).otherwise(F.lit(0.0))

    return let(text, entropy)


def first_label(query: Column) -> Column:
    return F.split(query, r"\.").getItem(0)


def strip_dots(query: Column) -> Column:
    return F.regexp_replace(query, r"\.+$", "")


def is_known_infra(query: Column, strict: bool = False, suffixes: list[str] | None = None) -> Column:
    """Name ends with a known suffix; ``strict`` asks for a dot before it."""
    name = F.lower(strip_dots(query))
    hit = F.lit(False)
    for suffix in suffixes or KNOWN_INFRA_SUFFIXES:
        ends = (name == suffix) | name.endswith("." + suffix) if strict else name.endswith(suffix)
        hit = hit | ends
    return F.coalesce(hit, F.lit(False))


def dns_features(query: Column) -> dict[str, Column]:
    """The feature columns of a DNS query; null for an empty query."""
    label = first_label(query)
    n = F.length(query)
    columns = {
        "domain_length": n.cast("bigint"),
        "shannon_entropy": shannon_entropy(query),
        "label_entropy": shannon_entropy(label),
        "label_length": F.length(label).cast("bigint"),
        "digit_ratio": count_matching(query, r"\p{Nd}") / n,
        "is_known_infra_suffix": is_known_infra(query),
    }
    return {name: F.when(n > 0, expr) for name, expr in columns.items()}


def longest_consonant_run(text: Column) -> Column:
    runs = F.split(F.regexp_replace(text, "[^b-df-hj-np-tv-z]", " "), " ")
    return F.array_max(F.transform(runs, lambda r: F.length(r)))


def lexical_vector(text: Column) -> Column:
    """Seven shape features of a name, each in [0, 1]; zeros for empty text."""

    def shape(t: Column) -> Column:
        n = F.length(t)
        return F.when(n > 0, F.array(
            F.least(n / MAX_LABEL, F.lit(1.0)),
            F.least(shannon_entropy(t) / MAX_ENTROPY, F.lit(1.0)),
            count_matching(t, r"\p{Nd}") / n,
            count_matching(t, "aeiou") / n,
            F.size(_characters(t)) / n,
            F.least(longest_consonant_run(t) / MAX_RUN, F.lit(1.0)),
            count_matching(t, r"\-") / n,
        )).otherwise(F.array(*[F.lit(0.0)] * len(LEXICAL_NAMES)))

    return let(text, shape)


def sanitise_domain(text: Column) -> Column:
    return F.regexp_replace(text, r"[^a-z0-9\-.]", "-")


def name_variants(ascii_name: Column, plain_name: Column) -> Column:
    """Forms of a name to score: whole, mapped plain form, last two labels, long labels.

    In this order, without repeats; the length of a name bounds them. ``ascii_name`` and ``plain_name``
    differ only for internationalised names.
    """
    none = F.array().cast("array<string>")
    plain = sanitise_domain(plain_name)
    mapped = F.when((ascii_name != plain_name) & (plain != ""), F.array(plain)).otherwise(none)

    def collect(whole: Column) -> Column:
        def from_labels(labels: Column) -> Column:
            pair = F.array(F.array_join(F.slice(labels, -2, 2), "."))
            long_labels = F.filter(labels, lambda p: F.length(p) >= MIN_LABEL)
            extra = F.when(F.size(labels) >= 2, F.concat(pair, long_labels)).otherwise(none)
            every = F.array_distinct(F.concat(F.array(whole), mapped, extra))
            return F.when(whole != "", every).otherwise(none)

        return let(F.filter(F.split(whole, r"\."), lambda p: p != ""), from_labels)

    return let(sanitise_domain(ascii_name), collect)


def character_windows(variants: Column) -> Column:
    """Overlapping 35-character windows over each variant, plus the last 35 characters.

    All of them: a long name has many windows, and any may be the one that tells.
    """
    def cut(names: Column) -> Column:
        def windows(name: Column) -> Column:
            n = F.length(name)
            starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)), F.lit(STEP))
            steps = F.transform(starts, lambda i: F.substring(name, i, WINDOW))
            tail = F.when((n - WINDOW) % STEP != 0, F.array(F.substring(name, -WINDOW, WINDOW))).otherwise(
                F.array().cast("array<string>"))
            return F.when(n > WINDOW, F.concat(steps, tail)).otherwise(F.array(name))

        return F.flatten(F.transform(names, windows))

    return let(variants, cut)


def registrable_domain(query: Column) -> Column:
    """Last two labels when both are valid host labels, else null."""
    labels = F.filter(F.split(F.lower(strip_dots(F.trim(query))), r"\."), lambda p: p != "")

    def check(pair: Column) -> Column:
        name = F.array_join(pair, ".")
        valid = F.forall(pair, lambda p: p.rlike(_LABEL)) & (F.length(name) <= 253)
        return F.when((F.size(pair) == 2) & valid, name)

    # slice() from the end yields nothing when there are fewer labels than asked for.
    return let(F.slice(labels, -2, 2), check)
