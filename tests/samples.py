"""Flows of known behaviour around one base time."""

from __future__ import annotations

import datetime as dt

BASE = dt.datetime(2026, 10, 5, 8, 0, 0, tzinfo=dt.timezone.utc)
BASE_US = int(BASE.timestamp()) * 1_000_000


def flow(at: float, src="10.0.0.1", dst="192.168.1.1", dport=443, sport=50000, proto="TCP", size=500, hours=0):
    """One flow ``at`` seconds after the base time."""
    us = BASE_US + round((at + 3600 * hours) * 1_000_000)
    return (us, src, dst, sport, dport, proto, size)


def benign(n=200, span=600.0):
    ports = (443, 80, 53, 8080)
    return [flow(i * span / n, f"10.0.0.{1 + i % 50}", f"192.168.1.{1 + i % 20}", ports[i % 4], size=200 + (i * 37) % 900)
            for i in range(n)]


def scan(ports, span, start=0.0, src="203.0.113.9"):
    return [flow(start + i * span / ports, src, "192.168.1.200", 1000 + i) for i in range(ports)]


def burst(n, port=22, span=5.0, start=0.0):
    return [flow(start + i * span / n, "203.0.113.9", "192.168.1.200", port) for i in range(n)]


def dns(n, span):
    return [flow(i * span / n, "10.0.0.99", "192.168.1.53", 53, proto="UDP", size=120) for i in range(n)]


def beacon(n, period, jitter=0.0):
    return [flow(i * period + (jitter if i % 2 else -jitter) + 1, "10.0.0.77", "203.0.113.150") for i in range(n)]


def night(n, hour_shift=-5):
    return [flow(i * 5, "10.0.0.88", f"192.168.1.{1 + i % 3}", 443 if i % 3 else 22, hours=hour_shift) for i in range(n)]


def kinds(alerts):
    return sorted((r.alert_type, r.severity, r.source_ip, r.dest_ip) for r in alerts.collect())
