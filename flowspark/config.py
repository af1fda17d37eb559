"""Parameters of every detector and report, as plain frozen dataclasses.

Nothing in the library reads a global: callers build a ``Settings`` (or take the
default one) and hand it to the plans.  Times are seconds here and become integer
microseconds (``us``) at the edge of a plan, so window arithmetic never touches
floating point.
"""

from __future__ import annotations

from dataclasses import dataclass, field


def us(seconds: float) -> int:
    """Seconds as whole microseconds."""
    return int(round(seconds * 1_000_000))


# Defaults every detector must share with the behaviour we reproduce.
AUTH_PORTS = (21, 22, 23, 25, 110, 143, 445, 1433, 3306, 3389, 5432, 5900)
DNS_PORTS = (53,)
STATIC_BLOCKLIST = ("192.0.2.66", "192.0.2.99", "203.0.113.200", "198.51.100.128/28")
STRICT_PROTOCOLS = ("TCP", "UDP", "ICMP")
ML_FEATURES = ("packet_length", "src_conn_freq", "src_bytes_window", "pair_conn_freq")


@dataclass(frozen=True)
class PortScan:
    window_s: float = 5.0
    ports_over: int = 10          # violated by MORE distinct ports than this
    high_from_ports: int = 50     # distinct ports in the whole incident


@dataclass(frozen=True)
class BruteForce:
    window_s: float = 10.0
    connections_over: int = 20
    high_from_peak: int = 40
    ports: tuple[int, ...] = AUTH_PORTS   # empty: every destination port


@dataclass(frozen=True)
class DnsTunnel:
    window_s: float = 60.0
    queries_over: int = 50
    high_over_peak: int = 100     # strictly over
    ports: tuple[int, ...] = DNS_PORTS


@dataclass(frozen=True)
class Beaconing:
    connections_over: int = 10
    std_below_s: float = 2.0
    high_std_below_s: float = 0.5
    high_from_connections: int = 20
    mean_from_s: float = 5.0
    session_gap_s: float = 1.0
    tile_s: float = 600.0         # one sort group covers at most this much time of a pair


@dataclass(frozen=True)
class OffHours:
    business_start: int = 6
    business_end: int = 22
    connections_over: int = 100
    high_over: int = 500
    top_ports: int = 5

    @property
    def label(self) -> str:
        return f"{self.business_end % 24:02d}:00-{self.business_start:02d}:00"


@dataclass(frozen=True)
class Forest:
    trees: int = 300
    max_samples: int = 256
    contamination: float = 0.03
    seed: int = 42
    window_s: float = 10.0
    high_at: float = -0.15
    medium_at: float = -0.05
    min_rows: int = 50
    warmup_rows: int = 20_000     # streaming: rows that train the stored model


@dataclass(frozen=True)
class Report:
    top_n: int = 10
    timeline_buckets: int = 48
    recent_alerts: int = 15
    slices: int = 40


@dataclass(frozen=True)
class Settings:
    port_scan: PortScan = field(default_factory=PortScan)
    brute_force: BruteForce = field(default_factory=BruteForce)
    dns: DnsTunnel = field(default_factory=DnsTunnel)
    beaconing: Beaconing = field(default_factory=Beaconing)
    off_hours: OffHours = field(default_factory=OffHours)
    forest: Forest = field(default_factory=Forest)
    report: Report = field(default_factory=Report)
    blocklist: tuple[str, ...] = STATIC_BLOCKLIST
    list_limit: int = 20          # peers / resolvers / sample ports shown per alert
    port_limit: int = 10          # destination ports shown per beacon or ML alert
    tile_windows: int = 16        # sliding rules: tile length, in windows
    seq_block: int = 1_000_000    # no longer read: features cut tie groups by volume


DEFAULT = Settings()
