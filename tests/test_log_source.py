import io
import random

import pytest
from pyspark.sql import functions as F

from connlens.operators import joins
from connlens.sources import conn_log, log_source
from connlens.sources.files import listed
from connlens.sources.log_source import Split, follow_logs, scan_log
from helpers import at, rows

HEAD = "#separator \\x09\n#fields\tts\tuid\tproto\tservice\tduration\torig_bytes\n"
OTHER = "#fields\tuid\tts\thistory\tproto\n"


class Bytes(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_splits_hold_every_line_once(monkeypatch, chunk):
    monkeypatch.setattr(log_source, "CHUNK", chunk)
    draw = random.Random(chunk)
    for _ in range(30):
        text = "".join(draw.choice(["a", "bb\n", "\n", "ccc ccc", "é\n", "x\r\n"]) for _ in range(40)).encode()
        expected, place = [], 0
        for line in text.split(b"\n"):
            if place < len(text):
                expected.append((place, line))
            place += len(line) + 1
        size = draw.randint(1, 30)
        got = []
        for start in range(0, len(text), size):
            split = Split("x", 0, start, min(len(text), start + size), start == 0)
            for starts, lines in log_source._lines(Bytes(text), split, len(text)):
                got += list(zip(starts.tolist(), lines, strict=True))
        assert got == expected, (text, size)


@pytest.mark.parametrize("edge", [5, 65536])
def test_header_is_found_before_the_first_data_line(monkeypatch, edge):
    monkeypatch.setattr(log_source, "EDGE", edge)
    for text, names in ((HEAD + "1\tx\n", ["ts", "uid", "proto", "service", "duration", "orig_bytes"]), ("#a\n\n#fields\tuid", ["uid"]), ("1\tx\n#fields\tuid\n", None), ("", None), ("#only\n", None)):
        assert log_source.header_of(Bytes(text.encode()), len(text)) == names


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.log").write_text(HEAD + "1704067200.123456\tC1\ttcp\t-\t1.5\t10\n1704067201\tC2\tudp\tdns\tNaN\t-\n#close\n\n1704067209\tC1\ticmp\n")
    (tmp_path / "b.log").write_text(OTHER + "C3\t1704067202.5\tS#x\ticmp\r\nC2\t1704067203\tD\tsctp\textra\n")
    (tmp_path / "_hidden").write_text("no log\n")
    (tmp_path / "empty.log").write_text("")
    return str(tmp_path)


@pytest.mark.parametrize("split_bytes", [1 << 20, 20])
def test_each_file_is_read_by_its_own_header(spark, folder, split_bytes):
    out = scan_log(spark, folder, split_bytes=split_bytes).orderBy("line_no").collect()
    assert [(r["uid"], r["proto"], r["history"]) for r in out] == [("C1", "tcp", None), ("C2", "udp", None), ("C1", "icmp", None), ("C3", "icmp", "S#x"), ("C2", "sctp", "D")]
    assert out[0]["ts"] == at(0.123456) and out[0]["orig_bytes"] == 10 and out[0]["service"] is None and out[1]["duration"] is None and out[2]["duration"] is None
    assert out[0]["file"].endswith("a.log") and out[3]["file"].endswith("b.log")


def test_the_two_readers_agree(spark, folder):
    order = ["uid", "ts", "proto", "service", "duration", "orig_bytes"]
    numbered = conn_log.read_conn_log(spark, folder + "/*.log", numbered=True)
    assert rows(scan_log(spark, folder), *order) == rows(numbered, *order)
    # All lines count: two of a.log's header, one of b.log's.
    assert [r["line_no"] for r in numbered.orderBy("line_no").collect()] == [3, 4, 7, 9, 10]


def test_numbers_run_on_over_splits(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text("#fields\tuid\tts\n" + "".join(f"{name}{i}\t{1704067200 + i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        out = conn_log.read_conn_log(spark, [str(tmp_path / "b"), str(tmp_path / "a")], numbered=True).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["uid"] for r in out] == [f"{n}{i}" for n in "ab" for i in range(3000)]
    assert [r["line_no"] for r in out] == [*range(2, 3002), *range(3003, 6003)]


def test_first_and_last_lines_of_files(spark, folder):
    results = spark.createDataFrame([("C1", at(0), 0.1, "normal"), ("C2", at(0), 0.1, "normal"), ("C9", at(0), 0.1, "normal")], "uid string, timestamp timestamp, score double, prediction string")
    for log in (scan_log(spark, folder), conn_log.read_conn_log(spark, folder + "/*.log", numbered=True).withColumn("dest_port", F.lit(1))):
        log = log.withColumn("dest_port", F.lit(1))
        assert rows(joins.enrich_last(results, log), "uid", "proto") == [("C1", "icmp"), ("C2", "sctp"), ("C9", "not_found")]
        first = joins.one_line_per_uid(log, ["proto"], "first")
        assert rows(first) == [("C1", "tcp"), ("C2", "udp"), ("C3", "icmp")]


def test_missing_header_missing_folder_and_given_layout(spark, tmp_path):
    (tmp_path / "x.log").write_text("1704067200\tC1\ttcp\n")
    with pytest.raises(Exception, match="#fields"):
        scan_log(spark, str(tmp_path)).collect()
    assert rows(scan_log(spark, str(tmp_path), fields=["ts", "uid", "proto"], columns=["uid", "proto"]), "uid", "proto") == [("C1", "tcp")]
    with pytest.raises(Exception, match="nowhere"):
        scan_log(spark, str(tmp_path / "nowhere")).collect()


def test_patterns_name_files_or_their_folders(tmp_path):
    for name in ("a/x.log", "a/y.txt", "b/x.log", "b/.part", "b/_c/x.log"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("")

    def found(pattern):
        return [f.path.removeprefix(f"{tmp_path}/") for f in listed(f"{tmp_path}{pattern}")[1]]

    assert found("") == ["a/x.log", "a/y.txt", "b/x.log"] and found("/*/x.*") == ["a/x.log", "b/x.log"] and found("/b*") == ["b/x.log"] and found("/a/y.txt") == ["a/y.txt"]


def test_stream_follows_growing_files_line_by_line(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")

    def run():
        lines = follow_logs(spark, str(logs), columns=["uid", "proto"])
        query = lines.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None
        return rows(spark.read.parquet(table), "uid", "proto")

    (logs / "a.log").write_text(HEAD + "1\tC1\ttcp\n2\tC2\tud")
    assert run() == [("C1", "tcp")]
    # The half line is read when it is whole; a new file has another layout.
    with open(logs / "a.log", "a") as f:
        f.write("p\n3\tC3\ttcp\n")
    (logs / "b.log").write_text(OTHER + "C4\t1\tS\ticmp\n")
    assert run() == [("C1", "tcp"), ("C2", "udp"), ("C3", "tcp"), ("C4", "icmp")]
    assert len(run()) == 4
    # A file that is shorter than before was begun anew and is read from its start.
    (logs / "b.log").write_text(OTHER + "C5\t1\tS\n")
    assert [uid for uid, _ in run()] == ["C1", "C2", "C3", "C4", "C5"]
