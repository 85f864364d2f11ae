"""Expressions on visual memories and frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mnemora.functions.activation import clamp


def emotional_weight(arousal: Column) -> Column:
    return 0.5 + clamp(arousal, 0.0, 1.0)


def boost(significance: Column, weight: Column) -> Column:
    """What significance and a strong emotion add to the activation of a visual memory."""
    return significance * 0.2 + F.when(weight > 0.7, (weight - 0.7) * 0.3).otherwise(0.0)


def significant(arousal: Column, valence: Column, threshold: float = 0.7) -> Column:
    return (arousal > threshold) | (F.abs(valence) > threshold)


def tag_strength(confidence: Column | float, accesses: Column, significance: Column) -> Column:
    more = F.greatest(F.lit(0.0), (significance - 0.6) * 0.5)
    return F.least(confidence + 0.3 * (1.0 - 1.0 / (1.0 + 0.1 * accesses)) + more, F.lit(1.0))


def pruning(significance: Column, days: Column, pinned: Column, frame: Column) -> tuple[Column, Column]:
    """Reason and score of a candidate for pruning, both null where it is none."""
    kept = pinned | (frame == 0)
    reason = F.when(kept, None).when(days > 90, "stale").when(significance < 0.2, "low_significance")
    score = F.when(kept, None).when(days > 90, days / 90.0 * (1.0 - significance)).when(significance < 0.2, (0.2 - significance) * F.least(days / 14.0, F.lit(1.0)))
    return reason, score


def should_prune(significance: Column, days: Column, pinned: Column, keyframe: Column) -> Column:
    return ~pinned & ~keyframe & (((days > 90) & (significance < 0.2)) | ((days > 180) & (significance < 0.5)))


def half(c: Column, start: int) -> Column:
    """32 bits of a 64-bit hash in hex, from a place of its text on."""
    return F.conv(F.substring(c, start, 8), 16, 10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes in hex differ."""
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def frame_score(quality: Column, keyframe: Column, scene: Column, speech: Column) -> Column:
    return quality + F.when(keyframe, 0.3).otherwise(0.0) + F.when(scene, 0.5).otherwise(0.0) + F.when(speech, 0.2).otherwise(0.0)


#: What the descriptions of a frame and of a video are asked for with (fixed texts).
FRAME_REQUEST = """Describe this video frame concisely. Position: %s.%s%s%s

Respond with JSON:
{
  "description": "[200 chars max, what's happening in this frame]"
- objects: [list of key objects/people visible]
- valence: [-1 to 1, pleasant to unpleasant]
- arousal: [0 to 1, calm to exciting],
  "significance": [0 to 1, how memorable/important is this moment]
}"""
VIDEO_REQUEST = """Synthesize these frame descriptions into a cohesive 2-3 sentence summary of what this %ss video shows.
%s%s

Write a natural description that captures the essence of the video, not just a list of frames."""


def whole(seconds: Column) -> Column:
    """A number without decimals, halves to the even one."""
    return F.bround(seconds, 0).cast("bigint").cast("string")


def frame_request(at: Column, duration: Column, scene: Column, shared_by: Column, speech: Column) -> Column:
    """What a frame's description is asked for with; unknown durations, sharers and speech leave their part out."""
    place = F.when(duration > 0, F.concat(whole(at), F.lit("s/"), whole(duration), F.lit("s ("), whole(at / duration * 100.0), F.lit("% through)"))).otherwise(F.concat(whole(at), F.lit("s")))
    said = F.coalesce(F.concat(F.lit('\n\nAudio at this moment: "'), speech, F.lit('"')), F.lit(""))
    sharer = F.coalesce(F.concat(F.lit(" This was shared by "), shared_by, F.lit(".")), F.lit(""))
    return F.format_string(FRAME_REQUEST, place, F.when(scene, " This is a scene change.").otherwise(""), sharer, said)


def video_request(frames: Column, duration: Column, transcript: Column) -> Column:
    """What a video's summary is asked for with; ``frames`` is an array of struct(at, description) in order."""
    lines = F.transform(frames, lambda x, i: F.concat(F.lit("\nFrame "), (i + 1).cast("string"), F.lit(" ("), whole(x["at"]), F.lit("s): "), x["description"]))
    said = F.coalesce(F.concat(F.lit('\n\nTranscript:\n"'), transcript, F.lit('"')), F.lit(""))
    return F.format_string(VIDEO_REQUEST, whole(duration), F.array_join(lines, ""), said)


def video_metadata(probe: Column) -> Column:
    """struct(duration, width, height, fps, codec, audio) of a media probe's JSON; null where it is broken."""
    shape = "struct<streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string>>, format: struct<duration: string>>"
    x = F.from_json(probe, shape)
    picture = F.get(F.filter(x["streams"], lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.split(picture["r_frame_rate"], "/")
    over, under = F.get(rate, F.lit(0)).try_cast("double"), F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    fps = F.when(under != 0, over / under)
    sound = F.exists(x["streams"], lambda s: s["codec_type"] == "audio")
    return F.when(x["streams"].isNotNull(), F.struct(x["format"]["duration"].try_cast("double").alias("duration"), picture["width"].alias("width"), picture["height"].alias("height"), fps.alias("fps"), picture["codec_name"].alias("codec"), sound.alias("audio")))
