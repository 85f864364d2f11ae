"""Repeated consecutive frames as runs.

Associative run summaries: frames are pieces of length one, folded in cells of ``frame_number`` and then across the
cells' edges (:func:`mnemora.operators.runs.merge_runs`), so a video that holds a third of all frames is spread over
as many tasks as it has cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.operators.runs import merge_runs

#: Bits of frame_number below a cell: 2,048 frames; of the level above, 1,024 cells each.  An int has two such levels.
CELL_BITS = 11
LEVEL_BITS = 10
MAX_DISTANCE = 3


def _half(c: Column, start: int) -> Column:
    return F.conv(F.substring(c, start, 8), 16, 10).cast("bigint")


def frame_runs(frames: DataFrame, max_distance: int = MAX_DISTANCE, cell_bits: int = CELL_BITS, level_bits: int = LEVEL_BITS) -> DataFrame:
    """Runs of two or more frames in which each repeats the one before.

    Columns out: video_id, first_frame, last_frame, frames, started_s, ended_s, duration_s.  A frame repeats the one
    before if ``distance_from_previous <= max_distance``; where that is null, if the two hashes (64 bits in hex) differ
    in at most that many bits; where one of those is null or no hash, if ``is_duplicate``; null there is no repeat.
    The first frame of a video repeats nothing.

    Defined results: deliveries of one (video_id, frame_number) are one frame (of differing values the greatest
    counts, nulls last); rows without video_id or frame_number are left out; times are the least and greatest
    non-null ``timestamp_seconds`` of the run, and null, like the duration, where it has none; an empty table gives
    no rows; other columns are ignored, whatever their names.
    """
    cell = F.shiftright(F.col("frame_number").cast("bigint"), cell_bits)
    slim = frames.select("video_id", F.col("frame_number").cast("bigint").alias("first_frame"), "timestamp_seconds", "hash", "is_duplicate", "distance_from_previous", cell.alias("_cell"))
    slim = slim.filter("video_id is not null and first_frame is not null").repartition("video_id", "_cell")
    one = slim.groupBy("video_id", "_cell", "first_frame").agg(*[F.max(c).alias(c) for c in ("timestamp_seconds", "hash", "is_duplicate", "distance_from_previous")])
    hexed = F.when(F.col("hash").rlike("^[0-9A-Fa-f]{16}$"), F.col("hash"))
    pieces = one.select(
        "video_id",
        "first_frame",
        F.col("first_frame").alias("last_frame"),
        F.col("distance_from_previous").alias("distance"),
        F.col("is_duplicate").alias("flag"),
        _half(hexed, 1).alias("hi"),
        _half(hexed, 9).alias("lo"),
        _half(hexed, 1).alias("tail_hi"),
        _half(hexed, 9).alias("tail_lo"),
        F.lit(1).cast("bigint").alias("frames"),
        F.when(~F.isnan("timestamp_seconds"), F.col("timestamp_seconds")).alias("started_s"),
    ).withColumn("ended_s", F.col("started_s"))

    def linked(prev, _):
        bits = F.bit_count(F.col("hi").bitwiseXOR(prev("tail_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(prev("tail_lo")))
        by_hash = F.when(bits.isNotNull(), bits <= max_distance).otherwise(F.coalesce("flag", F.lit(False)))
        return F.when(F.col("distance").isNotNull(), F.col("distance") <= max_distance).otherwise(by_hash)

    runs = merge_runs(
        pieces,
        ["video_id"],
        "first_frame",
        [cell_bits, cell_bits + level_bits, None],
        linked,
        head=["distance", "flag", "hi", "lo"],
        tail=["last_frame", "tail_hi", "tail_lo"],
        total=["frames"],
        low=["started_s"],
        high=["ended_s"],
        keep=F.col("frames") > 1,
    )
    return runs.select("video_id", F.col("first_frame").cast("int").alias("first_frame"), F.col("last_frame").cast("int").alias("last_frame"), "frames", "started_s", "ended_s", (F.col("ended_s") - F.col("started_s")).alias("duration_s"))
