import random
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from connlens.operators import encoding, scaling
from connlens.operators.flows import anomaly_context
from connlens.operators.one_class import KernelModel
from connlens.operators.scoring import Detector, score_scan
from connlens.schemas import LOG_COLUMNS
from connlens.sources import tables
from connlens.sources.conn_log import read_conn_log
from connlens.streaming import context, detect
from helpers import at, rows


def write_log(folder, name, lines):
    text = ["#fields\t" + "\t".join(LOG_COLUMNS)]
    for second, uid, proto, duration in lines:
        cells = {"ts": f"{1704067200 + second}.5", "uid": uid, "proto": proto, "duration": duration, "orig_bytes": "10"}
        text.append("\t".join(str(cells.get(c, "-")) for c in LOG_COLUMNS))
    (folder / name).write_text("\n".join(text) + "\n\n#close\n")


def detector_for(log):
    return Detector(encoding.fit_encoder(log, order="ts"), scaling.fit_scaler(log, ["duration", "orig_bytes"]), KernelModel(((0.0, 0.0),), (1.0,), 0.5, 0.5))


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_detection_equals_the_batch_scan_and_drops_repeats(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_log(logs, "a.log", [(i, f"C{i}", "tcp", 0.1 * i) for i in range(20)])
    write_log(logs, "b.log", [(i, f"C{i}", "udp", 0.1 * i) for i in range(20, 40)])
    batch = read_conn_log(spark, str(logs))
    detector = detector_for(batch)
    want = rows(score_scan(batch.drop("history", "service"), detector, "post").filter("prediction = 'anomaly'"), "uid", "prediction", "timestamp")
    write_log(logs, "c.log", [(i, f"C{i}", "tcp", 0.1 * i) for i in range(15, 20)])
    found = detect.detect(detect.follow_log(spark, str(logs), files_per_trigger=1), detector, late="1 hour")
    finish(detect.write_anomalies(found, str(tmp_path / "csv"), str(tmp_path / "table"), str(tmp_path / "cp")))
    table = spark.read.parquet(str(tmp_path / "table"))
    assert len(want) > 0 and rows(table, "uid", "prediction", "timestamp") == want
    assert table.filter(F.get_json_object("raw_data", "$.uid") != F.col("uid")).count() == 0
    csv = spark.read.option("header", True).csv(str(tmp_path / "csv") + "/*")
    assert csv.columns == ["timestamp", "uid", "score", "prediction", "detected_at"] and csv.count() == len(want)
    # A restart from the same checkpoint reads only new files.
    write_log(logs, "d.log", [(100, "X", "tcp", 99.0)])
    again = detect.detect(detect.follow_log(spark, str(logs)), detector, late="1 hour")
    finish(detect.write_anomalies(again, str(tmp_path / "csv"), str(tmp_path / "table"), str(tmp_path / "cp")))
    assert rows(spark.read.parquet(str(tmp_path / "table")).filter("uid = 'X'"), "uid") == [("X",)]
    assert spark.read.parquet(str(tmp_path / "table")).count() == len(want) + 1


def test_lines_without_uid_and_late_lines_are_kept(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_log(logs, "a.log", [(90000 + i, "-", "tcp", 0.1 * i) for i in range(20)])
    write_log(logs, "b.log", [(i, "-", "udp", 0.1 * i) for i in range(20)])
    batch = read_conn_log(spark, str(logs))
    detector = detector_for(batch)
    want = score_scan(batch.drop("history", "service"), detector, "post").filter("prediction = 'anomaly'").count()
    found = detect.detect(detect.follow_log(spark, str(logs), files_per_trigger=1), detector)
    finish(detect.write_anomalies(found, str(tmp_path / "csv"), str(tmp_path / "table"), str(tmp_path / "cp")))
    assert want > 1 and spark.read.parquet(str(tmp_path / "table")).count() == want


def test_counters(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write_log(logs, "a.log", [(i * 60, f"C{i}", ["tcp", "udp"][i % 2], 1) for i in range(10)])
    write_log(logs, "b.log", [(600 + i * 60, f"D{i}", "tcp", 1) for i in range(10)])
    counted = detect.running_counters(detect.follow_log(spark, str(logs)), "10 minutes", "1 minute")
    query = counted.writeStream.outputMode("complete").format("memory").queryName("counters_test")
    finish(query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert rows(spark.table("counters_test"), "slot", "proto", "n") == [(at(0), "tcp", 5), (at(0), "udp", 5), (at(600), "tcp", 10)]


def test_context_over_several_batches_equals_the_batch_join(spark, tmp_path):
    draw = random.Random(4)
    schema = "iface string, ts timestamp, pkt_id bigint, uid string"
    source = str(tmp_path / "events")
    everything = []
    for part in range(3):
        data = [("eth0" if draw.random() < 0.8 else "eth1", at(part * 100 + draw.randrange(100)), part * 1000 + i, None) for i in range(150)]
        data += [("eth0", at(part * 100 + 50 + i), None, f"A{part}{i}") for i in range(4)]
        everything += data
        draw.shuffle(data)
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    answers = context.lane_answers(arriving, last=30, buffer=60, lanes=3)
    query = answers.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    finish(query.trigger(availableNow=True).start())
    got = context.newest_of_lanes(spark.read.parquet(str(tmp_path / "out")), 30)
    batch = spark.createDataFrame(everything, schema)
    want = anomaly_context(batch.filter("uid IS NULL"), batch.filter("uid IS NOT NULL"), 30)
    assert rows(got, "uid", "pkt_id", "back") == rows(want, "uid", "pkt_id", "back")


def test_counters_are_merged_and_survive_a_restart_and_a_repeat(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    root, checkpoint = str(tmp_path / "store"), str(tmp_path / "checkpoint")

    def run():
        counted = detect.running_counters(detect.follow_log(spark, str(logs), files_per_trigger=1), "10 minutes")
        finish(detect.write_counters(counted, root, checkpoint, buckets=3))
        return rows(detect.read_counters(spark, root), "slot", "proto", "n")

    write_log(logs, "a.log", [(i, f"C{i}", "tcp", 0.1) for i in range(20)])
    write_log(logs, "b.log", [(700 + i, f"D{i}", "udp", 0.1) for i in range(5)])
    assert run() == [(at(0), "tcp", 20), (at(600), "udp", 5)]
    write_log(logs, "c.log", [(i, f"E{i}", "tcp", 0.1) for i in range(3)] + [(700, "F", "tcp", 0.1)])
    want = [(at(0), "tcp", 23), (at(600), "tcp", 1), (at(600), "udp", 5)]
    assert run() == want and run() == want
    # A batch that comes again brings the same totals.
    again = spark.createDataFrame([(at(0), "tcp", 23)], "slot timestamp, proto string, n long").withColumn("key", F.concat_ws("|", F.col("slot").cast("string"), "proto"))
    tables.change(root, "counters", again, lambda old: old.drop("_bucket").join(again, "key", "left_anti").unionByName(again))
    assert rows(detect.read_counters(spark, root), "slot", "proto", "n") == want


def test_packets_later_than_the_anomaly_s_batch_count(spark, tmp_path):
    source, answers, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "iface string, ts timestamp, pkt_id bigint, uid string"

    def run(*events):
        spark.createDataFrame(list(events), schema).coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        found = context.late_lane_answers(arriving, "10 seconds", last=3, buffer=2, lanes=2, idle="1 minute")
        finish(found.writeStream.format("parquet").option("path", answers).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        return [(r["uid"], r["pkt_id"]) for r in context.newest_of_lanes(spark.read.schema(context.ANSWER).parquet(answers), 3).orderBy("uid", "pkt_id").collect()]

    packets = [("e", at(i), i, None) for i in range(1, 6)]
    assert run(*packets, ("e", at(6), None, "A")) == []
    # Out of order, after the anomaly's batch, before the watermark: it counts. A packet after the anomaly does not.
    assert run(("e", at(5.5), 50, None), ("e", at(7), 7, None)) == []
    assert run(("e", at(12), 12, None), ("f", at(12), 99, None)) == []
    assert run(("e", at(30), None, None)) == [("A", 4), ("A", 5), ("A", 50)]
    # Later anomalies of the same interface still find what they need; an idle lane ends.
    assert run(("e", at(31), None, "B"), ("e", at(60), None, None)) == [("A", 4), ("A", 5), ("A", 50), ("B", 7), ("B", 12), ("B", 50)]
    assert len(run(("g", at(500), 1, None))) == 6


def test_late_context_equals_the_batch_context(spark, tmp_path):
    draw = random.Random(5)
    packets = [(draw.choice("ef"), at(draw.randrange(1000)), i, None) for i in range(300)]
    asked = [(draw.choice("ef"), at(draw.randrange(1000)), None, f"A{i}") for i in range(40)]
    schema = "iface string, ts timestamp, pkt_id bigint, uid string"
    events = packets + asked
    draw.shuffle(events)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for at_ in range(0, len(events), 80):
        spark.createDataFrame(events[at_ : at_ + 80], schema).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("e", at(9000), None, None), ("f", at(9000), None, None)], schema).coalesce(1).write.mode("append").parquet(source)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    found = context.late_lane_answers(arriving, "1 hour", last=20, buffer=30, lanes=3)
    finish(found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    got = {}
    for r in context.newest_of_lanes(spark.read.schema(context.ANSWER).parquet(out), 20).collect():
        got.setdefault(r["uid"], set()).add(r["pkt_id"])
    for iface, when, _, uid in asked:
        before = sorted(((t, p) for i, t, p, _ in packets if i == iface and t <= when), reverse=True)[:20]
        assert got.get(uid, set()) == {p for _, p in before}


class Lane:
    """State of one lane, as the state function sees it."""

    def __init__(self, watermark):
        self.get, self.watermark = None, watermark

    @property
    def exists(self):
        return self.get is not None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get = value

    def setTimeoutTimestamp(self, when):
        self.wakes = when


def test_a_waiting_lane_holds_few_bytes_a_packet():
    n, state = 100_000, Lane(0)
    frame = pd.DataFrame({"us": np.arange(n) * 1000, "pkt_id": np.arange(n) + 10**12, "uid": [None] * n})
    asked = pd.DataFrame({"us": [50_000_000, 60_000_000], "pkt_id": [None, None], "uid": ["A\n\u00e9", "B"]})
    run = context.answer_when_due(3, 5, 1000)
    tracemalloc.start()
    assert list(run(("e", 0), iter([frame, asked]), state)) == []
    list(run(("e", 0), iter([frame[:0]]), state))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * n and sum(len(x) for x in state.get) < 17 * n
    state.watermark = 55_000
    (found,) = run(("e", 0), iter([frame[:0]]), state)
    assert found["uid"].tolist() == ["A\n\u00e9"] * 3 and found["pkt_id"].tolist() == [10**12 + i for i in (49_998, 49_999, 50_000)]
    state.watermark = 61_000
    (found,) = run(("e", 0), iter([]), state)
    assert found["uid"].tolist() == ["B"] * 3 and found["packet_us"].max() == 60_000_000


def test_an_answer_of_a_lane_is_one_row_and_repeated_uids_meet():
    n, state = 2000, Lane(0)
    packets = pd.DataFrame({"us": np.arange(n), "pkt_id": np.arange(n) * 3, "uid": [None] * n})
    asked = pd.DataFrame({"us": [-1, 700, 1999], "pkt_id": [None] * 3, "uid": ["none", "A", "B"]})
    state.update = lambda held: None
    frames = list(context.keep_last(500, 5000)(("e", 1), iter([packets, asked]), state))
    assert [len(f) for f in frames] == [2] and frames[0]["uid"].tolist() == ["A", "B"]
    assert frames[0]["packet_us"][0].tolist() == list(range(201, 701)) and len(frames[0]["pkt_id"][1]) == 500


def test_newest_of_lanes_merges_answers_of_a_repeated_uid(spark):
    draw = random.Random(8)
    answers, each = [], {}
    for uid, iface in (("A", "e"), ("A", None), (None, "e"), ("B", "e")):
        for lane in range(9):
            some = sorted((draw.randrange(40), draw.randrange(10**9)) for _ in range(draw.randrange(1, 8)))
            for _ in range(1 + (uid == "A")):
                answers.append((iface, lane, uid, [p for _, p in some], [t for t, _ in some]))
                each.setdefault((uid, iface), []).extend(some)
    got = {}
    for r in context.newest_of_lanes(spark.createDataFrame(answers, context.ANSWER), 5).orderBy("back").collect():
        got.setdefault((r["uid"], r["iface"]), []).append((r["back"], r["pkt_id"]))
    assert got == {k: [(i + 1, p) for i, (_, p) in enumerate(sorted(v, reverse=True)[:5])] for k, v in each.items()}
