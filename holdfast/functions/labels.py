"""Contact labels: codes, normalisation and binary maps, all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Contact states and sides of a hand, by code.
STATES = {0: "No Contact", 1: "Self Contact", 2: "Other Person Contact", 3: "Portable Object", 4: "Stationary Object Contact"}
SIDES = {0: "Left", 1: "Right"}
#: Which label wins in a frame, by strategy.
PRIORITIES = {
    "no_contact_first": ["No Contact", "Portable Object", "Stationary Object"],
    "portable_first": ["Portable Object", "Stationary Object", "No Contact"],
}
NO_CONTACT, PORTABLE, STATIONARY = "No Contact", "Portable Object", "Stationary Object"


def state_label(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in STATES.items() for x in kv]), code.cast("int"))


def side_label(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv]), code.cast("int"))


def condensed(label: Column) -> Column:
    """Portable and stationary with or without "Contact"; anything else, null too, is No Contact."""
    return F.when(label.isin(PORTABLE, PORTABLE + " Contact"), PORTABLE).when(label.isin(STATIONARY, STATIONARY + " Contact"), STATIONARY).otherwise(NO_CONTACT)


def strict(label: Column) -> Column:
    """As ``condensed``, but labels that are none of the three are null."""
    return F.when(label == NO_CONTACT, NO_CONTACT).when(label.isin(PORTABLE, PORTABLE + " Contact"), PORTABLE).when(label.isin(STATIONARY, STATIONARY + " Contact"), STATIONARY)


_VARIANTS = {
    "timeline": {"1": ["holding", "contact", "1", "true", "yes"]},
    "evaluator": {"1": ["holding", "contact", "1", "portable object"], "0": ["not_holding", "not holding", "no_contact", "no contact", "0"]},
}


def binary(label: Column, variant: str = "evaluator", positives: tuple[str, ...] | None = None) -> Column:
    """1 or 0. ``timeline``: unknown labels, also Portable Object, are 0. ``evaluator``: unknown labels are null (an error to
    the caller). ``exact``: 1 for Portable Object as it stands. ``positives``: the caller's own list."""
    clean = F.lower(F.trim(label))
    if positives is not None:
        return F.coalesce(clean.isin(*[p.strip().lower() for p in positives]), F.lit(False)).cast("int")
    if variant == "exact":
        return (F.coalesce(label, F.lit("")) == PORTABLE).cast("int")
    if variant == "timeline":
        return F.coalesce(clean.isin(*_VARIANTS["timeline"]["1"]), F.lit(False)).cast("int")
    return F.when(clean.isin(*_VARIANTS["evaluator"]["1"]), 1).when(clean.isin(*_VARIANTS["evaluator"]["0"]), 0)


def probability(confidence: Column) -> Column:
    """Percent or probability to probability: values up to 1 count as probabilities; null and NaN are 0."""
    c = F.when(confidence.isNull() | F.isnan(confidence.cast("double")), 0.0).otherwise(confidence.cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(c <= 1, c).otherwise(c / 100)))


def best_class(scores: Column) -> Column:
    """The place (from 0) of the largest of an array of scores, the first of equals."""
    return F.array_position(scores, F.array_max(scores)) - 1


def likely(score: Column) -> Column:
    """Whether a logit's sigmoid is over one half."""
    return (1 / (1 + F.exp(-score))) > 0.5


def threshold(value: float | None, default: float) -> float:
    """A threshold given as percent or probability, within 0 and 1."""
    v = default if value is None or value != value else float(value)
    return max(0.0, min(1.0, v / 100 if v > 1 else v))


def priority(label: Column, strategy: str = "no_contact_first") -> Column:
    if strategy not in PRIORITIES:
        raise ValueError(f"unknown strategy {strategy!r}; choices: {sorted(PRIORITIES)}")
    out = F.lit(None).cast("int")
    for rank, name in enumerate(PRIORITIES[strategy], 1):
        out = F.when(label == name, rank).otherwise(out)
    return out
