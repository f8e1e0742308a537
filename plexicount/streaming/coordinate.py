"""Streams of alignments in coordinate order.

The coordinate is the event time, a millisecond for each base, contig after contig: a
group closes once the stream has come ``gap`` bases further, or to another contig.  Reads
of a UMI at a place are counted first, combined in the task, and the closed counts of a
place meet in a second aggregation; both keep their state by place, so no key
holds a contig.  What comes back after its group closed is late and left out, as the
watermark says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kernels import clusters

GAP = 1000
#: Bases, hence milliseconds, from the beginning of a contig to that of the next.
CONTIG = 1 << 32
KEYS = ["tid", "start", "is_reverse", "tlen_key"]


def group_stream(reads: DataFrame, method: str = "directional", threshold: int = 1, gap: int = GAP) -> DataFrame:
    """reads: a stream with tid, start, is_reverse, tlen_key, umi, ordinal.  Rows of closed
    groups: keys, umi, n, lead, lead_n.  A read of a null umi only moves the coordinate
    on: one behind the last closes what is left."""
    timed = reads.withColumn("at", F.timestamp_millis((F.col("tid").cast("long") + 1) * CONTIG + F.col("start"))).withWatermark("at", f"{gap} milliseconds")
    # No filter, which would be moved to before the watermark is taken: null umis fall out where lists are made.
    counted = timed.groupBy("at", *KEYS, "umi").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    places = counted.groupBy("at", *KEYS).agg(F.sort_array(F.collect_list(F.when(F.col("umi").isNotNull(), F.struct("first", "umi", "n")))).alias("members"))
    kernel = F.transform("members", lambda m: F.struct(m.umi.alias("umi"), m.n.alias("n"), m["first"].alias("first")))
    return places.select(*KEYS, clusters(method, threshold)(kernel).alias("made")).select(*KEYS, F.inline("made")).select(*KEYS, "umi", "n", "lead", "lead_n")


def windowed_counts(reads: DataFrame, time: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Distinct UMIs seen per contig in windows of event time, with a watermark."""
    return reads.withWatermark(time, late).groupBy(F.window(time, window), "contig").agg(F.approx_count_distinct("umi", 0.01).alias("umis"), F.count("*").alias("reads"))
