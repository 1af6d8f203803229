"""Small frames and comparisons shared by the tests."""

from __future__ import annotations

import datetime as dt


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=str)


def at(seconds: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


CONN = (
    "uid string, line_no bigint, ts timestamp, source_ip string, source_port int, dest_ip string, dest_port int, proto string, "
    "service string, duration double, orig_bytes bigint, resp_bytes bigint, orig_pkts bigint, resp_pkts bigint, history string"
)


def conn(spark, lines):
    """``lines``: (uid, line_no, proto, service[, duration]) tuples."""
    data = []
    for line in lines:
        uid, n, proto, service, duration = (*line, None)[:5]
        data.append((uid, n, at(n), f"10.0.0.{n}", 1000 + n, "192.168.0.1", n, proto, service, duration, 10 * n, None, n, n, "Dd"))
    return spark.createDataFrame(data, CONN)
