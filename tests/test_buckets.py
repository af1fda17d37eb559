"""Keyed state of many keys: a state for each bucket, not for each key."""

from __future__ import annotations

import random

import pandas as pd
from samples import flow
from test_streaming import FEW_TREES, walked
import pytest

from flowspark.plans.brute_force import brute_force_rule
from flowspark.plans.port_scan import port_scan_rule
from flowspark.streaming.detector import StreamDetector
from flowspark.streaming.keyed import BUCKETS, FOREVER, Bucket, SlidingProcessor


@pytest.mark.parametrize("make", [port_scan_rule, brute_force_rule])
def test_bucket_in_steps_equals_one_walk(make):
    rule, draw, some = SlidingProcessor(make()).rule, random.Random(7), 0
    object.__setattr__(rule, "window_us", 8)
    object.__setattr__(rule, "over", 3)
    object.__setattr__(rule, "limit", 2)
    for _ in range(40):
        rows = [(draw.randint(0, 20) ** 2 % 7, draw.randint(0, 120), str(draw.randint(1, 6)), draw.randint(1, 2), draw.randint(0, 9)) for _ in range(200)]
        held, got, mark = Bucket(rule), [], -1
        for upto in [*sorted(draw.sample(range(0, 120), 4)), FOREVER]:
            part = [(*[f"k{r[0]}"] * len(rule.keys), *r[1:]) for r in rows if mark < r[1] <= upto]
            held.add(iter([pd.DataFrame(part, columns=[*rule.keys, "ts_us", "cell", "n", "bytes"])]))
            got += held.advance(upto)
            held = Bucket(rule).load(held.mark_us, held.body())
            mark = upto
        want = [(*[f"k{k}"] * len(rule.keys), *i) for k in range(7) for i in walked([r[1:] for r in rows if r[0] == k], 8, 3, rule.value is not None)]
        if rule.cell is None or not rule.numeric:            # cells are listed in another order
            got, want = [r[:-1] for r in got], [r[:-1] for r in want]
        some += len(want)
        assert sorted(got) == sorted(want) and held.rows is None and not held.open
    assert some > 100


def test_states_are_bounded_by_buckets(spark, flows, folder):
    detector = StreamDetector(spark, folder, FEW_TREES, delay_s=1, names=["port_scan"], ml=False)
    keys = BUCKETS + 500
    detector.process(flows([flow(i / keys, f"10.1.{i // 250}.{i % 250}", "192.168.1.1", 80) for i in range(keys)]), 0)
    detector.process(flows([flow(3, "10.0.0.1", "192.168.1.1", 80)]), 1)
    detector.slide()
    (one,) = detector.sliding
    assert one.buckets().count() < BUCKETS < one.states().count()
