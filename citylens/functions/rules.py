"""First-match rule lists and the injury severity rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citylens.functions.text import clean_text


def first_match(rules: list[tuple[Column, object]], default: object = None) -> Column:
    """Label of the first rule that holds; a NULL condition counts as not holding."""
    if not rules:
        return F.lit(default)
    head, *rest = rules
    chain = reduce(lambda acc, rule: acc.when(rule[0], F.lit(rule[1])), rest, F.when(head[0], F.lit(head[1])))
    return chain.otherwise(F.lit(default))  # lit leaves a column as it is


def label_by_sets(column: Column, sets: dict[str, list], default: object = None) -> Column:
    """CASE over membership: ``{label: values}``; no default leaves unmatched rows NULL."""
    return first_match([(column.isin(values), label) for label, values in sets.items()], default)


# Wording of the person feed (upper-cased) that decides injury severity.
SEVERE_STATUS = ["UNCONSCIOUS", "SEMICONSCIOUS", "INCOHERENT"]
ORDINARY_STATUS = ["APPARENT DEATH", "SHOCK", "CONSCIOUS", "UNKNOWN", "DOES NOT APPLY"]
SERIOUS_COMPLAINT = [
    "AMPUTATION", "CONCUSSION", "INTERNAL", "SEVERE BLEEDING", "MODERATE BURN", "SEVERE BURN",
    "FRACTURE - DISLOCATION", "FRACTURE - DISTORTED - DISLOCATION", "CRUSH INJURIES", "PARALYSIS",
    "SEVERE LACERATIONS",
]
MINOR_COMPLAINT = [
    "MINOR BLEEDING", "MINOR BURN", "COMPLAINT OF PAIN", "COMPLAINT OF PAIN OR NAUSEA",
    "CONTUSION - BRUISE", "ABRASION",
]
NO_COMPLAINT = ["UNKNOWN", "NONE VISIBLE", "DOES NOT APPLY"]
UNSTATED_BODY_PART = ["UNKNOWN", "DOES NOT APPLY"]
# End of fixed values.


def severity(injury: str, status: str, complaint: str, body_part: str) -> Column:
    """K killed, A serious, B minor, C possible, U unknown.

    Only distinctions that can decide a row are made: the body part of a minor complaint never
    changes its letter.  A missing value belongs to no word list, so it falls through to U.
    """
    return _letter(*[clean_text(c) for c in (injury, status, complaint, body_part)])


def with_severity(df: DataFrame, out: str, injury: str, status: str, complaint: str, body_part: str) -> DataFrame:
    """Add the letter of ``severity``.  Each text is cleaned once, in a projection below the rules."""
    names = [f"_clean_{i}" for i in range(4)]
    cleaned = df.withColumns(dict(zip(names, [clean_text(c) for c in (injury, status, complaint, body_part)])))
    return cleaned.withColumn(out, _letter(*[F.col(n) for n in names])).drop(*names)


def _letter(hurt: Column, state: Column, pain: Column, part: Column) -> Column:
    """The decision tree over cleaned texts."""
    unhurt = (state == "CONSCIOUS") & part.isin(UNSTATED_BODY_PART)
    by_complaint = first_match(
        [
            (pain.isin(SERIOUS_COMPLAINT), "A"),
            (pain.isin(MINOR_COMPLAINT), "B"),
            (pain == "WHIPLASH", "C"),
            (pain.isin(NO_COMPLAINT), F.when(unhurt, "U").otherwise("C")),
        ],
        default="U",
    )
    by_status = first_match([(state.isin(SEVERE_STATUS), "A"), (state.isin(ORDINARY_STATUS), by_complaint)], default="U")
    return first_match([(hurt == "KILLED", "K"), (hurt == "INJURED", by_status)], default="U")
