"""Features of rows against a plain count, with ties across destinations and rows at the window's edge."""

from __future__ import annotations

import random
from dataclasses import replace

from flowspark.config import DEFAULT, Forest
from flowspark.plans.features import flow_features
from samples import flow


def test_features_equal_a_plain_count(flows):
    draw = random.Random(5)
    rows = [flow(draw.randrange(0, 40), f"10.0.0.{draw.randrange(3)}", f"192.168.1.{draw.randrange(2)}", size=draw.randrange(9)) for _ in range(300)]
    got = flow_features(flows(rows), replace(DEFAULT, forest=Forest(window_s=10.0))).orderBy("seq").collect()
    want = []
    for a in got:
        before = [b for b in got if b.src_ip == a.src_ip and (b.ts_us, b.seq) <= (a.ts_us, a.seq) and b.ts_us >= a.ts_us - 10_000_000]
        want.append((len(before), sum(b.packet_length for b in before), sum(b.dst_ip == a.dst_ip for b in before)))
    assert len(got) == 300 and [(r.src_conn_freq, r.src_bytes_window, r.pair_conn_freq) for r in got] == want
