"""Three-valued constraint verdicts.

A verdict is struct<field, status, detail, low_confidence> with status ``pass``,
``fail`` or ``unknown``; it is NULL where the requirement does not state the
constraint.  A missing catalog value yields ``unknown``, never ``fail``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from partlens.functions.text import field_key, number_text

PASS, FAIL, UNKNOWN = "pass", "fail", "unknown"

# Catalog fields behind each constraint, as they may be named in a low-confidence list.
FLAG_NAMES = {
    "output_type": ["output_type", "switching_output"],
    "io_link": ["io_link", "interface", "switching_output"],
    "connector": ["connector", "connection"],
    "connector_pins": ["connector_pins", "connector", "connection"],
    "min_ip_rating": ["ip_rating", "enclosure_rating"],
    "ip69k": ["ip69k", "ip_rating", "enclosure_rating"],
    "operating_temp_c": ["operating_temp_c", "operating_temp_min_c", "operating_temp_max_c"],
    "sensing_range_mm": ["sensing_range_mm", "sensing_range_min_mm", "sensing_range_max_mm"],
    "response_time_ms": ["response_time_ms"],
    "switching_frequency_hz": ["switching_frequency_hz"],
    "supply_voltage_v": ["supply_voltage_v", "supply_voltage_min_v", "supply_voltage_max_v"],
    "principle": ["principle", "sensor_principle", "detection_principle"],
    "housing": ["housing", "housing_material"],
    "light": ["light", "light_type"],
}


@dataclass(frozen=True)
class Verdict:
    """One constraint as columns.  ``status`` is NULL where it is not stated; ``detail`` is only built on demand."""

    field: str
    status: Column
    detail: Callable[[], Column]
    flagged: Column

    def struct(self) -> Column:
        shaky = self.flagged & (self.status != UNKNOWN)
        whole = F.struct(
            F.lit(self.field).alias("field"),
            self.status.alias("status"),
            self.detail().alias("detail"),
            F.coalesce(shaky, F.lit(False)).alias("low_confidence"),
        )
        return F.when(self.status.isNotNull(), whole)


def low_confidence_flag(flags: Column, field: str) -> Column:
    """Whether any catalog field behind a constraint is on the low-confidence list, in any spelling."""
    names = [n.replace("_", "") for n in FLAG_NAMES.get(field, [field])]
    folded = F.transform(flags, lambda f: field_key(f))
    return F.coalesce(F.arrays_overlap(folded, F.array(*[F.lit(n) for n in names])), F.lit(False))


def _span(lo: Column, hi: Column, unit: str) -> Column:
    """A printed interval, open on a side that is not stated."""
    return (
        F.when(lo == hi, F.concat(number_text(lo), F.lit(f" {unit}")))
        .when(lo.isNotNull() & hi.isNotNull(), F.concat(number_text(lo), F.lit(" to "), number_text(hi), F.lit(f" {unit}")))
        .when(hi.isNotNull(), F.concat(F.lit("up to "), number_text(hi), F.lit(f" {unit}")))
        .when(lo.isNotNull(), F.concat(F.lit("from "), number_text(lo), F.lit(f" {unit}")))
    )


def _detail(asked: Column, found: Column, silent: str) -> Column:
    return F.concat(F.lit("requires "), asked, F.lit(", catalog "),
                    F.coalesce(F.concat(F.lit("states "), found), F.lit(f"does not state {silent}")))


def _bounded(want: Column) -> Column:
    return want["min"].isNotNull() | want["max"].isNotNull()


def _flag(flagged: Column | None) -> Column:
    return F.lit(False) if flagged is None else flagged


def verdict_enum(field: str, label: str, value: Column, allowed: Column, inconclusive: Sequence[str] = (),
                 flagged: Column | None = None, normalize: Callable[[Column], Column] | None = None) -> Verdict:
    """Membership.  An empty list states nothing; a sentinel value answers nothing unless it was asked for."""
    wanted = F.array_compact(allowed)
    same = normalize or (lambda c: c)
    hit = F.array_contains(F.transform(wanted, same) if normalize else wanted, same(value))
    unresolved = value.isin(*inconclusive) if inconclusive else F.lit(False)
    status = F.when(
        F.size(wanted) > 0,
        F.when(value.isNull(), UNKNOWN).when(hit, PASS).when(unresolved, UNKNOWN).otherwise(FAIL),
    )

    def detail() -> Column:
        return _detail(F.concat(F.lit(f"{label} "), F.array_join(wanted, " or ")), value, label)

    return Verdict(field, status, detail, _flag(flagged))


def verdict_scalar(field: str, label: str, unit: str, value: Column, want: Column,
                   flagged: Column | None = None) -> Verdict:
    """A stated value inside inclusive bounds."""
    status = F.when(
        _bounded(want),
        F.when(value.isNull(), UNKNOWN)
        .when((value < want["min"]) | (value > want["max"]), FAIL)
        .otherwise(PASS),
    )

    def detail() -> Column:
        return _detail(F.concat(F.lit(f"{label} "), _span(want["min"], want["max"], unit)), _span(value, value, unit), label)

    return Verdict(field, status, detail, _flag(flagged))


def verdict_window_cover(field: str, label: str, unit: str, low: Column, high: Column, want: Column,
                         flagged: Column | None = None) -> Verdict:
    """A capability window covering the asked distance(s).

    One asked bound is a single distance.  The far end must be stated for a
    pass; the near end need not be.  A stated bound that is violated fails.
    """
    near, far = F.coalesce(want["min"], want["max"]), F.coalesce(want["max"], want["min"])
    status = F.when(
        _bounded(want),
        F.when(low.isNull() & high.isNull(), UNKNOWN)
        .when((far > high) | (near < low), FAIL)
        .when(high.isNull(), UNKNOWN)
        .otherwise(PASS),
    )

    def detail() -> Column:
        return _detail(F.concat(F.lit(f"{label} at "), _span(near, far, unit)), _span(low, high, unit), label)

    return Verdict(field, status, detail, _flag(flagged))


def verdict_contains(field: str, label: str, unit: str, low: Column, high: Column, want: Column,
                     flagged: Column | None = None) -> Verdict:
    """A stated interval covering the asked one; only the asked sides count."""
    violated = (low > want["min"]) | (high < want["max"])
    open_side = (want["min"].isNotNull() & low.isNull()) | (want["max"].isNotNull() & high.isNull())
    status = F.when(
        _bounded(want),
        F.when(low.isNull() & high.isNull(), UNKNOWN)
        .when(violated, FAIL)
        .when(open_side, UNKNOWN)
        .otherwise(PASS),
    )

    def detail() -> Column:
        return _detail(F.concat(F.lit(f"{label} "), _span(want["min"], want["max"], unit)), _span(low, high, unit), label)

    return Verdict(field, status, detail, _flag(flagged))


def verdict_within(field: str, label: str, unit: str, low: Column, high: Column, want: Column,
                   flagged: Column | None = None) -> Verdict:
    """An asked value inside the accepted range; both ends must be stated for a pass."""
    near, far = F.coalesce(want["min"], want["max"]), F.coalesce(want["max"], want["min"])
    status = F.when(
        _bounded(want),
        F.when(low.isNull() & high.isNull(), UNKNOWN)
        .when((near < low) | (far > high), FAIL)
        .when(low.isNull() | high.isNull(), UNKNOWN)
        .otherwise(PASS),
    )

    def detail() -> Column:
        return _detail(F.concat(F.lit(f"{label} "), _span(near, far, unit)), _span(low, high, unit), label)

    return Verdict(field, status, detail, _flag(flagged))


def _simple(field: str, label: str, want: Column, value: Column, ok: Column, asked: Callable[[], Column],
            found: Callable[[], Column], flagged: Column | None) -> Verdict:
    status = F.when(want.isNotNull(), F.when(value.isNull(), UNKNOWN).when(ok, PASS).otherwise(FAIL))
    return Verdict(field, status, lambda: _detail(asked(), found(), label), _flag(flagged))


def verdict_min(field: str, label: str, value: Column, want: Column, flagged: Column | None = None) -> Verdict:
    asked = lambda: F.concat(F.lit(f"{label} of at least "), number_text(want))
    return _simple(field, label, want, value, value >= want, asked, lambda: number_text(value), flagged)


def verdict_exact(field: str, label: str, value: Column, want: Column, flagged: Column | None = None) -> Verdict:
    asked = lambda: F.concat(F.lit(f"{label} of exactly "), number_text(want))
    return _simple(field, label, want, value, value == want, asked, lambda: number_text(value), flagged)


def verdict_flag(field: str, label: str, value: Column, want: Column, flagged: Column | None = None) -> Verdict:
    word = lambda c: F.when(c, label).otherwise(f"no {label}")
    found = lambda: F.when(value.isNotNull(), word(value))
    return _simple(field, label, want, value, value == want, lambda: word(want), found, flagged)


def verdict_flag_with_witness(field: str, label: str, value: Column, witness: Column, want: Column,
                              flagged: Column | None = None) -> Verdict:
    """A flag that is only ever set or absent: absent means *no* only where the witness field is stated."""
    has = F.coalesce(value, F.lit(False))
    known = F.when(has | witness.isNotNull(), has)
    return verdict_flag(field, label, known, want, flagged)


def downgrade_inferred(verdict: Verdict, source: Column, inferred: str = "category") -> Verdict:
    """A fail that rests on an inferred value proves nothing: it becomes unknown."""
    weak = F.coalesce((verdict.status == FAIL) & (source == inferred), F.lit(False))
    status = F.when(weak, UNKNOWN).otherwise(verdict.status)

    def detail() -> Column:
        note = F.concat(verdict.detail(), F.lit(f"; inferred from the {inferred}, so it cannot disqualify"))
        return F.when(weak, note).otherwise(verdict.detail())

    return Verdict(verdict.field, status, detail, verdict.flagged)


def verdict_structural(field: str, label: str, value: Column, allowed: Column, ignore_case: bool = True) -> Verdict:
    """Section, family and row type, read off the row itself and never low-confidence."""
    return verdict_enum(field, label, value, allowed, normalize=F.upper if ignore_case else None)
