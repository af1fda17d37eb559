"""Streams give the results of a batch run."""

from __future__ import annotations

import glob
import os
import random
from dataclasses import replace

import numpy as np
from samples import beacon, benign, burst, dns, flow, kinds, night, scan
import pytest
from pyspark.sql import functions as F

from flowspark.config import DEFAULT, Forest
from flowspark.plans import engine
from flowspark.schema import FLOW
from flowspark.sources.logs import layout_of, text_lines
from flowspark.streaming.detector import StreamDetector
from flowspark.streaming.keyed import FOREVER, KeyState
from flowspark.streaming.live import live_traffic
from flowspark.sources.profiles import NATIVE_HEADER, resolve_layout
from flowspark.streaming.logs import detect_logs, log_counts, parse_batch

FEW_TREES = replace(DEFAULT, forest=Forest(trees=20, warmup_rows=300))


def everything():
    rows = [*benign(), *scan(60, 4, 58), *burst(45, start=118), *dns(130, 55), *beacon(40, 30, 0.1),
            flow(30, "10.0.0.5", "192.0.2.66"), flow(400, "10.0.0.6", "192.0.2.66"), *night(150, -5)]
    return sorted(rows)


def test_file_stream_equals_batch(spark, flows, folder):
    rows = flows(everything())
    ordered = rows.orderBy("ts_us").collect()
    part = len(ordered) // 5 + 1
    for i in range(5):       # one file per micro-batch, in time order; attacks span the cuts
        spark.createDataFrame(ordered[i * part:(i + 1) * part], FLOW).coalesce(1).write.parquet(f"{folder}/new")
        (made,) = glob.glob(f"{folder}/new/*.parquet")
        os.makedirs(f"{folder}/in", exist_ok=True)
        os.utime(made, (1_700_000_000 + 10 * i,) * 2)
        os.rename(made, f"{folder}/in/{i}.parquet")
        os.rename(f"{folder}/new", f"{folder}/old-{i}")
    stream = spark.readStream.schema(FLOW).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    detector = StreamDetector(spark, f"{folder}/state", FEW_TREES, delay_s=2)
    detector.start(stream, availableNow="true").awaitTermination()
    steps = sorted(detector.counters().collect(), key=lambda r: r.batch)
    assert len(steps) == 5 and steps[3].final_rows > 0.7 * len(ordered)      # work is done in every batch, not at the end
    assert detector.result().rules.count() > 0
    result = detector.finish()
    assert kinds(result.rules) == kinds(engine.rule_alerts(rows, FEW_TREES))
    # What a key may hold: final rows of the last window, those not final yet, and nothing of keys that are over.
    for one in detector.sliding:
        states = one.states().select("value.*").collect()
        assert len(states) < len({(r.src_ip, r.dst_ip, r.dst_port) for r in ordered})
        for r in states:
            held = KeyState(one.rule.window_us, one.rule.over, False, 1).load(r.mark_us, r.body)
            past = held.ts[held.ts <= held.mark_us]
            assert held.open or not len(past) or past[0] > held.mark_us - one.rule.window_us
    assert result.ml is not None and result.ml.count() > 0
    assert detector.counters().agg({"late": "max"}).first()[0] == 0


def walked(rows, window, over, distinct):
    """Incidents of one key with the sums of their rows, by walking whole instants in order."""
    out = []
    for t in sorted({r[0] for r in rows}):
        inside = [r for r in rows if t - window <= r[0] <= t]
        size = len({r[1] for r in inside}) if distinct else sum(r[2] for r in inside)
        if size > over:
            left = min(r[0] for r in inside)
            if out and left <= out[-1][1] + window:
                out[-1][1:] = [t, max(out[-1][2], size)]
            else:
                out.append([left, t, size])
    full = []
    for a, b, peak in out:
        mine = [r for r in rows if a <= r[0] <= b]
        full.append((a, b, peak, sum(r[2] for r in mine), sum(r[3] for r in mine), len({r[1] for r in mine}), sorted({r[1] for r in mine}, key=int)[:2]))
    return full


@pytest.mark.parametrize("distinct", [False, True])
def test_key_state_in_steps_equals_one_walk(distinct):
    """Rows in any order inside a step, marks between them, state stored and loaded after every step."""
    draw, some = random.Random(5), 0
    for _ in range(150):
        rows = [(draw.randint(0, 120), str(draw.randint(1, 6)), draw.randint(1, 2), draw.randint(0, 9)) for _ in range(draw.randint(1, 60))]
        cuts = sorted(draw.sample(range(0, 120), 4))
        held, got, mark = KeyState(8, 3, distinct, 2, True), [], -1
        for upto in [*cuts, FOREVER]:
            part = [r for r in rows if mark < r[0] <= upto]
            held.add(np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], object), *(np.array([r[i] for r in part], np.int64) for i in (2, 3)))
            got += held.advance(upto)
            assert not len(held.ts) or held.ts[-1] - held.ts[0] <= 24
            held = KeyState(8, 3, distinct, 2, True).load(held.mark_us, held.body())
            mark = upto
        want = walked(rows, 8, 3, distinct)
        some += len(want)
        assert got == want and held.open is None and not len(held.ts)
    assert some > 100


def test_incidents_across_batches_and_late_rows(spark, flows, folder):
    detector = StreamDetector(spark, folder, FEW_TREES, delay_s=1, names=["port_scan"], ml=False)
    attack = scan(20, 4, 100)
    detector.process(flows(benign(50, 100), attack[:12]), 0)
    detector.process(flows(attack[12:]), 1)
    detector.process(flows(attack[12:]), 1)                          # a retried batch changes nothing
    detector.process(flows([flow(400)], [flow(1, "203.0.113.9")]), 2)   # one row far too late
    assert kinds(detector.result().rules) == [("PORT_SCAN", "MEDIUM", "203.0.113.9", "192.168.1.200")]
    result = detector.finish()
    (only,) = result.rules.collect()
    assert "20 unique ports" in only.description
    last = max(detector.counters().collect(), key=lambda r: r.batch)
    assert (last.late, last.final_rows) == (1, 71)
    (late,) = detector.late.read_all().collect()
    assert (late.src_ip, late.ts_us) == ("203.0.113.9", flow(1)[0])


def test_log_files_stream(spark, folder):
    header = "timestamp,src_ip,dst_ip,src_port,dst_port,protocol,packet_length"
    for n in range(2):
        with open(f"{folder}/{n}.csv", "w") as f:
            f.write("\n".join([header, *[f"2026-10-05 08:00:{n:02d}.{i:06d},10.0.0.9,10.0.0.1,5,{n * 100 + i},TCP,60" for i in range(8)],
                               "broken,row"]))
    detector = StreamDetector(spark, f"{folder}/state", FEW_TREES, delay_s=60, names=["port_scan"], ml=False)
    layout = layout_of(text_lines(spark, f"{folder}/0.csv"), "auto")
    detect_logs(spark, f"{folder}/*.csv", layout, detector).awaitTermination()
    assert kinds(detector.finish().rules) == [("PORT_SCAN", "MEDIUM", "10.0.0.9", "10.0.0.1")]
    assert spark.read.parquet(f"{folder}/state/rejects/batch=*").count() == 2
    assert sorted(tuple(r) for r in log_counts(spark, f"{folder}/state").read_all(with_batch=True).collect()) == [(9, 8, 1, 0), (9, 8, 1, 1)]


def test_row_numbers_of_many_batches(spark):
    lines = spark.createDataFrame([("f", "2026-10-05 08:00:00,10.0.0.1,10.0.0.2,1,2,TCP,5")] * 3, "source string, value string")
    layout = resolve_layout(NATIVE_HEADER, None, lambda text: False)
    seqs = [r.seq for b in (0, 1, 8_192, (1 << 21) - 1) for r in parse_batch(lines, b, layout).flows.orderBy("seq").collect()]
    assert seqs == sorted(set(seqs)) and len(seqs) == 12 and min(seqs) >= 0
    with pytest.raises(ValueError, match="beyond"):
        parse_batch(lines, 1 << 21, layout)


def test_warm_up_does_not_depend_on_batches(spark, flows, folder):
    found = []
    for name, cuts in (("a", (0, 60, 130, 200)), ("b", (0, 199, 200))):
        detector = StreamDetector(spark, f"{folder}/{name}", replace(DEFAULT, forest=Forest(trees=10, warmup_rows=55)), delay_s=1, names=["dns"])
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            detector.process(flows(sorted(benign())[a:b]).withColumn("seq", F.col("ts_us")), i)
        detector.finish()
        found.append(spark.read.parquet(f"{folder}/{name}/model/nodes").orderBy("tree", "node").collect())
    assert found[0] == found[1]


def test_live_counts(spark, flows, folder):
    flows(benign()).write.parquet(f"{folder}/in")
    live = live_traffic(spark.readStream.schema(FLOW).parquet(f"{folder}/in"), "1 minute", "10 seconds")
    query = live.writeStream.format("memory").queryName("live").option("checkpointLocation", f"{folder}/check").trigger(
        availableNow=True).start()
    query.awaitTermination()
    counted = spark.sql("select sum(records), count(*) from live").first()
    assert 150 <= counted[0] <= 200 and counted[1] >= 9
