"""Slow versions of the ranking metrics, one row at a time."""

from __future__ import annotations

from fractions import Fraction


def uplift_walk(treatment, outcome) -> list[float]:
    """After each row: the treated share of successes less the control share, by exact counts."""
    rows = {0: 0, 1: 0}
    successes = {0: 0, 1: 0}
    values = []
    for arm, success in zip(treatment, outcome, strict=True):
        rows[int(arm)] += 1
        successes[int(arm)] += int(success)
        if min(rows.values()) == 0:
            values.append(0.0)
        else:
            treated, control = (Fraction(successes[a], rows[a]) for a in (1, 0))
            values.append(float(treated) - float(control))
    return values
