"""The detection plan: named detectors over one flow table, merged into one alert table."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..config import DEFAULT, Settings
from ..session import stored
from . import alerts as algebra
from .beaconing import beacon_alerts
from .blocklist import blocklist_alerts
from .brute_force import brute_force_alerts
from .dns_tunnel import dns_alerts
from .forest import TooFewRecords, detect_anomalies
from .off_hours import off_hours_alerts
from .port_scan import port_scan_alerts

Detector = Callable[[DataFrame, Settings], DataFrame]

#: Rule detectors by name.  Add your own with ``register``: any function from flows to alerts.
DETECTORS: dict[str, Detector] = {
    "port_scan": port_scan_alerts,
    "brute_force": brute_force_alerts,
    "dns": dns_alerts,
    "beaconing": beacon_alerts,
    "time_of_day": off_hours_alerts,
}


def register(name: str, detector: Detector) -> None:
    DETECTORS[name] = detector


@dataclass
class Detection:
    """Named result tables; rule alerts are stored while the plan is built, and the forest, when
    enabled, trains eagerly."""

    alerts: DataFrame
    rules: DataFrame
    ml: DataFrame | None = None
    scored: DataFrame | None = None
    warnings: list[str] = field(default_factory=list)


def rule_alerts(flows: DataFrame, s: Settings = DEFAULT, feeds: DataFrame | None = None,
                names: Iterable[str] | None = None) -> DataFrame:
    """Union of the enabled rule detectors; ``names`` restricts them ("blocklist" included)."""
    names = [*DETECTORS, "blocklist"] if names is None else list(names)
    unknown = [n for n in names if n != "blocklist" and n not in DETECTORS]
    if unknown:
        raise ValueError(f"no such detector: {', '.join(unknown)}")
    frames = [DETECTORS[n](flows, s) for n in names if n != "blocklist"]
    if "blocklist" in names:
        frames.append(blocklist_alerts(flows, s, feeds))
    if not frames:
        raise ValueError("no detector named")
    return algebra.union_alerts(frames)


def detect(flows: DataFrame, s: Settings = DEFAULT, feeds: DataFrame | None = None,
           names: Iterable[str] | None = None, ml: bool = True) -> Detection:
    """Run every enabled detector; rule alerts corroborate ML alerts of the same source."""
    # Read twice, beside the ML alerts and to corroborate them.
    rules = stored(rule_alerts(flows, s, feeds, names), "rules")
    result = Detection(rules, rules)
    if flows.isEmpty():
        result.warnings.append("no records to analyse")
    elif ml:
        try:
            raised, result.scored, _ = detect_anomalies(flows, s)
            result.ml = algebra.corroborate(raised, rules)
            result.alerts = rules.unionByName(result.ml)
        except TooFewRecords as too_few:
            result.warnings.append(f"ML detection skipped: {too_few}")
    result.alerts = algebra.in_time_order(result.alerts)
    return result
