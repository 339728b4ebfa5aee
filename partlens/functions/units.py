"""Numbers and units out of printed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a printed number and its unit are written.
NUMBER = "(-?\\+?\\d[\\d.,]*)"
TEMP_RANGE = (
    "(?i)" + NUMBER + "\\s*(?:°?\\s*C)?\\s*(?:\\.{2,}|…|—|–|-{1,2}|a|to)\\s*" + NUMBER + "\\s*°?\\s*C"
)
PLAIN_NUMBER = "^-?(?:\\d+\\.?\\d*|\\.\\d+)$"
# Protocol names and how they are printed.
PROTOCOLS = [
    ("\\bIO-?Link\\b", "IO-Link"),
    ("\\bSSI\\b", "SSI"),
    ("\\bTTL\\s*/\\s*RS-?422\\b", "TTL/RS422"),
    ("\\bRS-?422\\b", "RS-422"),
    ("\\bRS-?232\\b", "RS-232"),
    ("\\bRS-?485\\b", "RS-485"),
    ("\\bHTL\\b", "HTL"),
    ("\\bTTL\\b", "TTL"),
    ("4\\s*(?:mA)?\\s*(?:\\.{2,}|…|-|a)\\s*20\\s*mA", "4-20mA"),
    ("\\b0\\s*V?\\s*(?:\\.{2,}|…|-|a)\\s*10\\s*V\\b", "0-10V"),
    ("\\bPROFINET\\b", "PROFINET"),
    ("\\bPROFIBUS\\b", "PROFIBUS"),
    ("\\bEtherNet/IP\\b", "EtherNet/IP"),
    ("\\bEtherCAT\\b", "EtherCAT"),
    ("\\bCANopen\\b", "CANopen"),
    ("\\bDeviceNet\\b", "DeviceNet"),
    ("\\bModbus\\b", "Modbus"),
    ("\\bUSB\\b", "USB"),
    ("\\bEthernet\\b", "Ethernet"),
]
# Scale of a unit word to the base unit of a field.
UNIT_SCALE = {
    "mm": {"": 1.0, "mm": 1.0, "cm": 10.0, "m": 1000.0, "um": 0.001, "µm": 0.001, "in": 25.4, "inch": 25.4, "ft": 304.8},
    "ms": {"": 1.0, "ms": 1.0, "s": 1000.0, "sec": 1000.0, "us": 0.001, "µs": 0.001, "ns": 1e-6, "min": 60000.0},
    "Hz": {"": 1.0, "hz": 1.0, "khz": 1000.0, "mhz": 1e6},
    "mA": {"": 1.0, "ma": 1.0, "a": 1000.0, "ua": 0.001, "µa": 0.001},
    "V": {"": 1.0, "v": 1.0, "vdc": 1.0, "vcc": 1.0, "mv": 0.001, "kv": 1000.0},
    "C": {"": 1.0, "c": 1.0, "°c": 1.0},
    "count": {"": 1.0},
}


def euro_number(c: Column) -> Column:
    """A number in European notation: dots group thousands, the comma is decimal."""
    s = F.regexp_replace(F.trim(c), "\\+", "")
    comma_to_point = "^([^,]*),"
    dot, comma = F.contains(s, F.lit(".")), F.contains(s, F.lit(","))
    plain = (
        F.when(dot & comma, F.regexp_replace(F.regexp_replace(s, "\\.", ""), comma_to_point, "$1."))
        .when(comma, F.regexp_replace(s, comma_to_point, "$1."))
        .when(s.rlike("^-?\\d{1,3}(\\.\\d{3})+$"), F.regexp_replace(s, "\\.", ""))
        .otherwise(s)
    )
    return F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double"))


def _numbers(c: Column, unit: str) -> Column:
    found = F.regexp_extract_all(c, F.lit("(?i)" + NUMBER + "\\s*" + unit + "\\b"), F.lit(1))
    return F.array_compact(F.transform(found, euro_number))


def parse_mm(c: Column) -> Column:
    """Largest printed length in millimetres; metres count only where no millimetres are printed."""
    text = F.regexp_replace(c, "\\s+", " ")
    mm, metres = _numbers(text, "mm"), _numbers(text, "m")
    return F.coalesce(F.array_max(mm), F.array_max(metres) * 1000)


def parse_temp_range(c: Column) -> Column:
    """struct<min,max> in degrees Celsius, NULL unless both ends are printed."""
    text = F.regexp_replace(c, "\\s+", " ")
    ends = [euro_number(F.nullif(F.regexp_extract(text, TEMP_RANGE, i), F.lit(""))) for i in (1, 2)]
    both = ends[0].isNotNull() & ends[1].isNotNull()
    return F.when(both, F.struct(F.least(*ends).alias("min"), F.greatest(*ends).alias("max")))


def parse_ms(c: Column) -> Column:
    """A time in milliseconds; microseconds count only where no milliseconds are printed."""
    ms = F.nullif(F.regexp_extract(c, "(?i)" + NUMBER + "\\s*ms\\b", 1), F.lit(""))
    us = F.nullif(F.regexp_extract(c, "(?i)" + NUMBER + "\\s*(?:µs|us|μs)\\b", 1), F.lit(""))
    return F.when(ms.isNotNull(), euro_number(ms)).otherwise(euro_number(us) / 1000)


def parse_ip(c: Column, mode: str = "worst") -> Column:
    """Enclosure rating of a text that may print several.

    ``worst``     struct<ip, ip69k>: the lowest two-digit rating.
    ``first``     struct<ip, ip69k>: the rating printed first.
    ``best_axis`` struct<solid, liquid, washdown>: the highest digit of each axis.
    """
    if mode == "best_axis":
        pattern = "(?i)IP\\s*(\\d|X)\\s*(\\d|K|X)?\\s*(K)?"

        def digits(group: int) -> Column:
            found = F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
            return F.array_max(F.filter(F.transform(found, lambda g: g.try_cast("int")), lambda g: g.isNotNull()))

        second = F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
        third = F.regexp_extract_all(c, F.lit(pattern), F.lit(3))
        is_k = lambda g: F.upper(g) == "K"
        k_mark = F.exists(second, is_k) | F.exists(third, is_k)
        solid = digits(1)
        liquid = F.when(k_mark, F.lit(9)).otherwise(digits(2))
        washdown = k_mark | c.rlike("(?i)69\\s*K")
        return F.when(
            solid.isNotNull() | liquid.isNotNull(),
            F.struct(solid.alias("solid"), liquid.alias("liquid"), washdown.alias("washdown")),
        )
    if mode == "first":
        digits_text = F.nullif(F.regexp_extract(c, "(?i)IP\\s*(\\d{2})\\s*(K?)", 1), F.lit(""))
        k_text = F.regexp_extract(c, "(?i)IP\\s*(\\d{2})\\s*(K?)", 2)
        ip = digits_text.cast("int")
        return F.struct(ip.alias("ip"), F.when((ip == 69) & (F.upper(k_text) == "K"), F.lit(True)).alias("ip69k"))
    if mode == "worst":
        found = F.regexp_extract_all(c, F.lit("(?i)ip\\s*(\\d{2})"), F.lit(1))
        ip = F.array_min(F.transform(found, lambda d: d.cast("int")))
        return F.struct(ip.alias("ip"), F.when(c.rlike("(?i)ip\\s*69\\s*k"), F.lit(True)).alias("ip69k"))
    raise ValueError(f"unknown mode {mode!r}")


def extract_protocols(texts: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Distinct protocol labels found in an array of texts, in order of appearance."""
    rules = patterns or PROTOCOLS
    per_text = F.transform(
        F.filter(texts, lambda t: t.isNotNull()),
        lambda t: F.array_compact(F.array(*[F.when(t.rlike("(?i)" + p), F.lit(label)) for p, label in rules])),
    )
    return F.array_distinct(F.flatten(per_text))


def asserted_value(text: Column, unit: Column) -> Column:
    """The first number of a claim in the base unit of its field."""
    pattern = "(?i)(-?\\d+(?:[.,]\\d+)?)\\s*(°?[a-zµ]*)"
    raw = F.regexp_replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), ",", ".").try_cast("double")
    word = F.lower(F.regexp_extract(text, pattern, 2))
    scales = F.create_map(
        *[F.lit(x) for kind, table in UNIT_SCALE.items() for w, s in table.items() for x in (f"{kind}|{w}", s)]
    )
    scale = F.coalesce(F.try_element_at(scales, F.concat(unit, F.lit("|"), word)), F.lit(1.0))
    return F.when((unit == "C") & word.isin("f", "°f"), (raw - 32) * 5 / 9).otherwise(raw * scale)


def close_to(a: Column, b: Column, tolerance: float = 0.05) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-6), F.greatest(F.abs(a), F.abs(b)) * tolerance)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clamped to [-1, 1]; 0 for empty, mismatched, zero or non-finite vectors."""
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    zero = F.struct(F.lit(0.0).alias("xy"), F.lit(0.0).alias("xx"), F.lit(0.0).alias("yy"))
    sums = F.aggregate(
        pairs,
        zero,
        lambda s, p: F.struct(
            (s["xy"] + p["x"] * p["y"]).alias("xy"),
            (s["xx"] + p["x"] * p["x"]).alias("xx"),
            (s["yy"] + p["y"] * p["y"]).alias("yy"),
        ),
    )
    value = sums["xy"] / (F.sqrt(sums["xx"]) * F.sqrt(sums["yy"]))
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (sums["xx"] > 0) & (sums["yy"] > 0)
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable & finite, F.least(F.lit(1.0), F.greatest(F.lit(-1.0), value))).otherwise(F.lit(0.0))


def range_fit(required: Column, stated_max: Column) -> Column:
    """How well a stated range suits a distance: margin helps up to 1.3x, excess costs beyond 2x."""
    ratio = stated_max / required
    return (
        F.when(stated_max < required, F.lit(0.0))
        .when(ratio < 1.3, F.lit(0.7) + (ratio - 1))
        .when(ratio <= 2, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.35), 1 - (ratio - 2) * 0.075))
    )
