"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to the base unit; two tables, as the two generations of comparisons differ (fixed values).
TIME_UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}
FREQUENCY_UNITS = {"Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9}
CYCLE_UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "tu": 1.0, "Hz": 1.0, "kHz": 1e3, "MHz": 1e6, "GHz": 1e9, "fu": 1.0}


def factor(unit: Column, units: dict[str, float]) -> Column:
    """A unit's factor, null for one that has none."""
    return F.create_map(*[F.lit(x) for pair in units.items() for x in pair])[unit]


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over a text's UTF-16 units, as 8 hex digits."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda u: F.conv(u, 16, 10).cast("long"))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def canonical_json(*parts: Column | str) -> Column:
    """The JSON array of some columns without blanks: texts quoted, whole numbers without a point, null as null. A str among
    the parts is JSON that is put in as it is."""

    def one(x: Column) -> Column:
        text = F.to_json(F.array(x))
        return F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"^(-?\d+)\.0$", "$1")

    return F.concat(F.lit("["), F.concat_ws(",", *[F.lit(p) if isinstance(p, str) else one(p) for p in parts]), F.lit("]"))


def signature(*parts: Column | str) -> Column:
    """The hash of the canonical JSON of some columns."""
    return fnv1a(canonical_json(*parts))


def normalised(x: Column, low: Column, high: Column) -> Column:
    """Where x lies between low and high, computed so that very large values don't overflow; null for an empty range."""
    size = F.greatest(F.abs(low), F.abs(high), F.lit(2.0**-1022))
    return F.when(high > low, (x / size - low / size) / (high / size - low / size))


def entity_id(kind: str, *parts: Column) -> Column:
    """A reproducible id of an entity: a hash of what it is made of."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha2(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), 256), 1, 16))


def rotated(values: Column, by: Column) -> Column:
    """An array that begins at place `by` and goes on from its start after its end."""
    return F.concat(F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0))), F.slice(values, F.lit(1), by))


def group_name(index: Column, names: list[str]) -> Column:
    """The name of group number index (0 or more): names in turn, then two of them joined, then three, and so on, as digits
    of a count that has no zero. One name alone is repeated."""
    n = len(names)
    if n == 1:
        return F.repeat(F.lit(names[0]), (index + 1).cast("int"))
    digits, reach = 1, n
    while reach < 1 << 63:  # so many digits name every long
        digits, reach = digits + 1, reach * n + n
    of = lambda k: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    start = F.struct(index.cast("long").alias("left"), F.lit("").alias("name"))
    step = lambda x, _: F.when(x["left"] >= 0, F.struct((F.call_function("div", x["left"], F.lit(n).cast("long")) - 1).alias("left"), F.concat(of(x["left"]), x["name"]).alias("name"))).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(digits)), start, step, lambda x: x["name"])


def lcg(seed: Column, steps: Column) -> Column:
    """The state of the linear congruential generator 1664525, 1013904223 mod 2^32 after some steps."""
    n = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(n, seed.cast("long"), lambda x, _: (x * 1664525 + 1013904223).bitwiseAND(F.lit(0xFFFFFFFF)))


#: A date, or a date and a time with or without a zone, as ISO 8601 writes them (fixed pattern).
_ISO = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$"


def is_instant(text: Column) -> Column:
    """Whether an ISO text is a point in time that exists; false for null."""
    whole = F.regexp_replace(text, r"(T\d{2}:\d{2})(?=Z|[+-]|$)", "$1:00")  # minutes alone aren't read with a zone
    return F.coalesce(text.rlike(_ISO) & F.try_to_timestamp(whole).isNotNull(), F.lit(False))


def has_keys(values: Column, keys: Column) -> Column:
    """Whether a map has exactly the keys of an array, whatever its values; false for a null map."""
    own = F.map_keys(values)
    return F.coalesce((F.size(F.array_except(own, keys)) == 0) & (F.size(F.array_except(keys, own)) == 0), F.lit(False))


def by_locale(name: Column) -> Column:
    """A text to be ordered by the root collation (ICU), as names are by locale."""
    return F.collate(name.cast("string"), "UNICODE")


def half_up(x: Column) -> Column:
    """Rounding to whole numbers, halves up."""
    return F.floor(x + 0.5)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow on either side."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def identifier_ok(x: Column) -> Column:
    """Whether a text can be an identifier: its pattern and the two reserved words are fixed values."""
    return F.coalesce(x.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,199}$") & ~x.isin("constructor", "prototype"), F.lit(False))
