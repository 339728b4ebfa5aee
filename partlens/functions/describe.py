"""Requirements out of a free description: target reflectivity, distance, output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partlens.functions.text import fold

# Words that imply a reflectivity class, darkest first, and distance units in mm.
REMISSION_WORDS = [
    ("negro|negra|negros|negras|oscuro|oscura|black|dark", "6pct"),
    ("carton|cartron|cardboard|madera|wood|marron|cafe|brown|gris|grey|gray|mate|matte", "20pct"),
    ("blanco|blanca|papel|paper|white|brillante|shiny|espejo|metal|acero|steel", "90pct"),
]
DISTANCE_UNITS = [("mm|milimetros?", 1), ("cm|centimetros?", 10), ("m|mts|metros?|meters?", 1000)]


def read_distance(c: Column) -> Column:
    """A distance in whole millimetres, in the finest unit that is written."""
    text = F.regexp_replace(fold(c), "^([^,]*),", "$1.")
    found = []
    for unit, scale in DISTANCE_UNITS:
        raw = F.nullif(F.regexp_extract(text, f"(\\d+(?:\\.\\d+)?)\\s*(?:{unit})\\b", 1), F.lit(""))
        found.append(F.floor(raw.cast("double") * scale + 0.5))
    return F.coalesce(*found)


def parse_description(c: Column, asked_remission: Column | None = None, asked_distance: Column | None = None) -> Column:
    """struct of remission, distance and output, each with where it came from: stated, asked or assumed."""
    text = fold(c)
    none = F.lit(None).cast("string")
    remission = None
    for words, value in REMISSION_WORDS:
        hit = text.rlike(f"\\b({words})\\b")
        remission = F.when(hit, value) if remission is None else remission.when(hit, value)
    asked = asked_remission if asked_remission is not None else none
    asked_mm = asked_distance if asked_distance is not None else F.lit(None).cast("bigint")
    # A stated distance of zero states nothing.
    stated_mm = F.nullif(read_distance(c), F.lit(0).cast("bigint"))
    output = F.when(text.rlike("\\bpnp\\b"), "PNP").when(text.rlike("\\bnpn\\b"), "NPN")
    origin = lambda stated, answer: F.when(stated.isNotNull(), "stated").when(answer.isNotNull(), "asked")
    return F.struct(
        F.coalesce(remission, asked).alias("remission"),
        origin(remission, asked).alias("remission_origin"),
        F.coalesce(stated_mm, asked_mm.cast("bigint")).alias("distance_mm"),
        origin(stated_mm, asked_mm).alias("distance_origin"),
        F.coalesce(output, F.lit("PNP")).alias("output"),
        F.when(output.isNotNull(), "stated").otherwise("assumed").alias("output_origin"),
    )
