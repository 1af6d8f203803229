"""Packets of a connection and the packets seen before an anomaly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from connlens.operators.ordered import running_totals
from connlens.operators.spread import sized_join, spread_join

# IP protocol numbers; the other protocols are matched on addresses alone.
PROTOCOL_NUMBERS = {"icmp": 1, "tcp": 6, "udp": 17, "sctp": 132}
WITH_PORTS = ("tcp", "udp")

#: Parts of an interface that are ranked on their own first.
LANES = 64


def _protocol(c: Column) -> Column:
    lower = F.lower(c)
    return F.when(lower == "icmpv6", "icmp").otherwise(lower)


def _pair(a: Column, b: Column) -> Column:
    """Text key equal for both directions."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def connection_key(df: DataFrame) -> DataFrame:
    """Key of the packets a connection asks for, by protocol class."""
    proto = _protocol(F.col("proto"))
    source, dest = F.col("source_ip"), F.col("dest_ip")
    ends = _pair(
        F.concat_ws("#", source, F.col("source_port").cast("string")), F.concat_ws("#", dest, F.col("dest_port").cast("string"))
    )
    key = (
        F.when(proto.isin(*WITH_PORTS), F.concat_ws("/", proto, ends))
        .when(proto.isin("icmp", "sctp"), F.concat_ws("/", proto, _pair(source, dest)))
        .otherwise(F.concat_ws("/", F.lit("any"), _pair(source, dest)))
    )
    return df.withColumn("flow_key", key)


def addresses_alone(keyed: DataFrame) -> bool:
    """Whether any connection is matched on its addresses alone."""
    return bool(keyed.filter(F.col("flow_key").startswith("any/")).limit(1).collect())


def packet_keys(packets: DataFrame, alone: bool = True) -> DataFrame:
    """One row per packet and key it can answer: its protocol class and, with ``alone``, its addresses."""
    proto = _protocol(F.col("proto"))
    source, dest = F.col("src"), F.col("dst")
    ends = _pair(F.concat_ws("#", source, F.col("sport").cast("string")), F.concat_ws("#", dest, F.col("dport").cast("string")))
    special = F.when(proto.isin(*WITH_PORTS), F.concat_ws("/", proto, ends)).when(
        proto.isin("icmp", "sctp"), F.concat_ws("/", proto, _pair(source, dest))
    )
    anyone = F.concat_ws("/", F.lit("any"), _pair(source, dest))
    if not alone:
        return packets.withColumn("flow_key", special).filter(F.col("flow_key").isNotNull())
    both = packets.withColumns({"_special": special, "_any": anyone})
    return both.withColumn("flow_key", F.explode(F.array_compact(F.array("_special", "_any")))).drop("_special", "_any")


def flow_packets(packets: DataFrame, connections: DataFrame) -> DataFrame:
    """The packets, both directions, of every flow asked for; each packet once per flow key."""
    wanted = connection_key(connections).select("flow_key")
    return sized_join(packet_keys(packets, addresses_alone(wanted)), wanted, "flow_key", "left_semi", distinct=True)


def flow_totals(packets: DataFrame, connections: DataFrame) -> DataFrame:
    """Packets, bytes and first and last time of each connection's flow.

    Packets are reduced to one row per flow key before the join, so a flow
    shared by many connections never pairs its packets with all of them.
    """
    keyed = connection_key(connections).select("uid", "flow_key")
    per_key = packet_keys(packets, addresses_alone(keyed)).groupBy("flow_key").agg(
        F.count("*").alias("n_packets"), F.sum("length").alias("n_bytes"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    joined = spread_join(keyed, per_key, "flow_key").fillna(0, ["n_packets", "n_bytes"])
    return joined.select("uid", "n_packets", "n_bytes", "first_ts", "last_ts")


def anomaly_context(packets: DataFrame, anomalies: DataFrame, last: int = 500) -> DataFrame:
    """The ``last`` packets seen on the anomaly's interface up to its time, newest first in ``back``.

    Packets and anomalies are numbered in one pass along (time, packet), so an
    anomaly knows how many packets came before it. Both sides then meet on
    (interface, block of ``last`` packets): an anomaly needs its own block and
    the one before it, a block holds ``last`` packets.
    """
    stream = packets.select("iface", "ts", F.lit(0).alias("kind"), F.col("pkt_id").cast("string").alias("key"), "pkt_id").unionByName(
        anomalies.select("iface", "ts", F.lit(1).alias("kind"), F.col("uid").alias("key")), allowMissingColumns=True
    ).withColumn("_order", F.when(F.col("kind") == 0, F.col("pkt_id")).otherwise(F.lit(0)))
    # The runs are written once; both sides number them from there.
    numbered = running_totals(stream, ["ts", "kind", "_order", "key"], {"rank": F.lit(1) - F.col("kind")}, ["iface"])
    seen = numbered.filter("kind = 0").select(
        "iface", F.floor((F.col("rank") - 1) / last).alias("_block"), "pkt_id", F.col("ts").alias("packet_ts"), F.col("rank").alias("_p")
    )
    newest = F.floor((F.col("rank") - 1) / last)
    asked = numbered.filter("kind = 1 and rank > 0").select(
        "iface", F.col("key").alias("uid"), F.col("rank").alias("_r"), F.explode(F.array(newest, newest - 1)).alias("_block")
    ).filter("_block >= 0")
    # Many anomalies may fall into one block; the block itself holds few packets.
    key = F.concat_ws("/", F.col("_block").cast("string"), "iface")
    met = spread_join(asked.withColumn("_key", key), seen.withColumn("_key", key).drop("iface", "_block"), "_key", "inner").filter((F.col("_p") <= F.col("_r")) & (F.col("_p") > F.col("_r") - last))
    return met.select("uid", "iface", "pkt_id", "packet_ts", (F.col("_r") - F.col("_p") + 1).alias("back"))


def newest_packets(packets: DataFrame, newest: int = 5000, lanes: int = LANES) -> DataFrame:
    """The newest packets of each interface.

    An interface may hold most of the packets, so it is first cut into lanes by
    a hash of the packet; the newest of every lane then compete, at most
    ``lanes * newest`` for an interface.
    """
    order = [F.col("ts").desc(), F.col("pkt_id").desc()]
    lane = F.pmod(F.xxhash64("pkt_id", "ts"), F.lit(lanes))
    few = packets.withColumn("_lane", lane).withColumn("_n", F.row_number().over(W.partitionBy("iface", "_lane").orderBy(*order))).filter(F.col("_n") <= newest)
    last = few.drop("_lane").withColumn("_n", F.row_number().over(W.partitionBy("iface").orderBy(*order)))
    return last.filter(F.col("_n") <= newest).drop("_n")
