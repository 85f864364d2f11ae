"""Choice of frames of a video."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.functions import visual as vis
from mnemora.operators.cells import numbered
from mnemora.sources.shared import materialize

#: A cell of the ordered work is 2 ** 12 frames wide; a bin of the range join is 10 seconds.
CELL_BITS, BIN_S = 12, 10.0


def _cell() -> Column:
    return F.shiftright("frame_number", CELL_BITS).cast("bigint")


def _placed(frames: DataFrame) -> DataFrame:
    """Frames with ``i``, their place in the video from 0."""
    return numbered(frames, ["video_id"], ["frame_number"], _cell()).withColumn("i", F.col("row") - 1).drop("row", "run")


def scene_changes(frames: DataFrame, new_scene: int = 12, duplicate: int = 3) -> DataFrame:
    """video_id, frame_number, hash, bits, scene, duplicate: what each frame is, by the bits in which it differs from the hashed frame before.

    The first hashed frame of a video begins a scene.  A frame without a hash has null bits and is neither.
    """
    f = frames.select("video_id", "frame_number", "hash")
    h = numbered(f.filter("hash is not null"), ["video_id"], ["frame_number"], _cell(), prev=["hash"])
    h = h.withColumn("bits", vis.hamming(F.col("hash"), F.col("prev_hash")))
    h = h.select("video_id", "frame_number", "hash", "bits", (F.col("bits").isNull() | (F.col("bits") >= new_scene)).alias("scene"), F.coalesce(F.col("bits") <= duplicate, F.lit(False)).alias("duplicate"))
    return h.unionByName(f.filter("hash is null").select("*", F.lit(None).cast("int").alias("bits"), F.lit(False).alias("scene"), F.lit(False).alias("duplicate")))


def scenes(changes: DataFrame) -> DataFrame:
    """The frames of :func:`scene_changes` with ``k``, the number of their scene in the video, from 1."""
    out = numbered(changes, ["video_id"], ["frame_number"], _cell(), lambda _, this: this("scene"), prev=["scene"])
    return out.withColumnRenamed("run", "k").drop("row", "prev_scene")


def in_speech(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """video_id, frame_number, text: the first segment (by start) that a frame lies in, both ends counted.

    ``segments`` has video_id, start_s, end_s and text.  Both sides meet in bins of ten seconds of a video, so a long
    video is spread over its bins.  Frames without a time, and those in no segment, have no row.
    """
    s = segments.filter("start_s <= end_s").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_s") / BIN_S), F.floor(F.col("end_s") / BIN_S))))
    f = frames.filter("timestamp_seconds is not null").select("video_id", "frame_number", "timestamp_seconds", F.floor(F.col("timestamp_seconds") / BIN_S).alias("bin"))
    met = f.join(s, ["video_id", "bin"]).filter(F.col("timestamp_seconds").between(F.col("start_s"), F.col("end_s")))
    return met.groupBy("video_id", "frame_number").agg(F.min_by("text", F.struct("start_s", "end_s", "text")).alias("text"))


def text_within(segments: DataFrame, start: Column, end: Column) -> DataFrame:
    """video_id, text: the texts of the segments that lie fully in a stretch, in order, with spaces between."""
    inside = segments.filter((F.col("start_s") >= start) & (F.col("end_s") <= end) & (F.col("start_s") <= F.col("end_s")))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start_s", "end_s", "text"))), lambda x: x["text"])
    return inside.groupBy("video_id").agg(F.array_join(texts, " ").alias("text"))


def frame_plan(videos: DataFrame, interval: float = 1.0, most: int = 100) -> DataFrame:
    """video_id, i, timestamp_seconds: the frames to take of each video, evenly over its ``duration``.

    One for each interval begun, ``most`` at most; a video of no or unknown length has none.
    """
    n = F.least(F.ceil(F.col("duration") / interval), F.lit(most)).cast("int")
    v = videos.filter("duration > 0").select("video_id", "duration", n.alias("n"))
    return v.select("video_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "duration", "n").select("video_id", "i", (F.col("i") * F.col("duration") / F.col("n")).alias("timestamp_seconds"))


def even_frames(frames: DataFrame, most: int) -> DataFrame:
    """video_id, frame_number: every n-th frame, and the last, of each video; all of one with no more than ``most``."""
    f = _placed(frames)
    f = f.join(frames.groupBy("video_id").agg(F.count("*").alias("n")), "video_id")
    step = F.floor(F.col("n") / most)
    kept = (F.col("n") <= most) | (F.col("i") == F.col("n") - 1) | ((F.col("i") % F.greatest(step, F.lit(1)) == 0) & (F.floor(F.col("i") / F.greatest(step, F.lit(1))) < most - 1))
    return f.filter(kept).select("video_id", "frame_number")


def select_frames(scores: DataFrame, most: int) -> DataFrame:
    """video_id, frame_number: up to ``most`` frames by score, spread over the video, its first and last among them.

    ``scores`` has video_id, frame_number and score.  Frames are taken by score (ties by number) unless one nearer
    than the least gap is taken already; the gap is 1 for short videos and ``n / (2 most)`` for longer ones.

    Each of the few steps is an aggregate over all frames of all videos: the best frame that isn't near one taken before.
    """
    f = _placed(scores)
    n = scores.groupBy("video_id").agg(F.count("*").alias("n"))
    gap = F.when(F.col("n") > 2 * most, F.floor(F.col("n") / (2 * most))).otherwise(1)
    f = f.join(n, "video_id").select("video_id", "frame_number", F.nanvl(F.col("score").cast("double"), F.lit(None)).alias("score"), "i", "n", gap.alias("gap"))
    f = materialize(f, "frames")  # each step reads it
    ends = F.array_distinct(F.array(F.lit(0).cast("bigint"), F.col("n") - 1)) if most >= 2 else F.array().cast("array<bigint>")
    taken = n.select("video_id", ends.alias("taken"))
    free = F.forall("taken", lambda t: F.abs(F.col("i") - t) >= F.col("gap"))
    for _ in range(min(most, 1) if most < 2 else most - 2):
        best = F.max(F.when(free, F.struct("score", (-F.col("i")).cast("bigint").alias("m")))).alias("best")
        taken = f.join(taken, "video_id").groupBy("video_id", "taken").agg(best)
        taken = taken.select("video_id", F.when(F.col("best").isNull(), F.col("taken")).otherwise(F.concat("taken", F.array(-F.col("best.m")))).alias("taken"))
    return f.join(taken, "video_id").filter(F.array_contains("taken", F.col("i").cast("bigint"))).select("video_id", F.col("frame_number").cast("int").alias("frame_number")).orderBy("video_id", "frame_number")
