"""Feature weights, the severity rule, labels and display bands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberwatch.functions.ipaddr import is_internal_server, is_private

# Feature weights and watched ports; labels start at 25, 50 and 75, bands at 40, 60
# and 80, and both scales end at 100.
LISTED_WEIGHT = 10
PUBLIC_WEIGHT = 3
PRIVATE_WEIGHT = 3
INTERNAL_WEIGHT = 5
PORT_WEIGHT = 5
COMMON_PORTS = [22, 90, 443, 3306, 8080]
LABEL_START, LABELS = 25, ["benign", "suspicious", "malicious", "critical"]
BAND_START, BANDS = 40, ["low", "medium", "high", "critical"]
SCALE_END = 100


def weight(flag: Column, points: int) -> Column:
    return flag.cast("int") * points


def source_security(ip: Column, listed: Column) -> Column:
    return weight(listed, LISTED_WEIGHT) + weight(~is_private(ip), PUBLIC_WEIGHT)


def destination_security(ip: Column) -> Column:
    return weight(is_private(ip), PRIVATE_WEIGHT) + weight(is_internal_server(ip), INTERNAL_WEIGHT)


def port_security(port: Column, ports: Sequence[int] = COMMON_PORTS) -> Column:
    return weight(F.coalesce(port.isin(*ports), F.lit(False)), PORT_WEIGHT)


def to_severity(raw: Column, known: Column | None = None) -> Column:
    """Clip to 0-100 and drop the fraction; a missing score or not-a-number gives null.

    ``known`` replaces that test where a cheaper one decides, so that ``raw`` is written once.
    """
    raw = raw.cast("double")
    if known is None:
        known = raw.isNotNull() & ~F.isnan(raw)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(float(SCALE_END)), raw))
    return F.when(known, clipped.cast("int"))


def rule_score(
    level: Column, source: Column, destination: Column, port: Column, noise: Column | None = None
) -> Column:
    """The linear severity rule before clipping, in doubles throughout."""
    raw = level.cast("double") / F.lit(15.0) * F.lit(60.0) + source * 2 + destination * 2 + port
    return raw if noise is None else raw + noise


def label_of(severity: Column) -> Column:
    return _step(severity, LABEL_START, LABELS)


def band_of(score: Column) -> Column:
    return _step(score, BAND_START, BANDS)


def _step(value: Column, start: int, names: list[str]) -> Column:
    """The name of the step a value is on; the steps above ``start`` are equally high.

    A chain of comparisons would repeat the value, and with it the whole score, once per step
    wherever a filter on the name is pushed down.
    """
    step = F.width_bucket(
        value.cast("double"), F.lit(float(start)), F.lit(float(SCALE_END)), F.lit(len(names) - 1)
    )
    named = F.array(*[F.lit(name) for name in names + names[-1:]])
    return F.get(named, step.cast("int"))
