"""Queries of frames, scenes, transcripts and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemora.functions import visual as vis
from mnemora.operators.frames import even_frames, frame_plan, in_speech, scene_changes, scenes, select_frames, text_within
from mnemora.queries.base import own, own_sql

c = F.col
r6 = lambda x: F.round(x, 6)


def _frames(spark, d):
    f = own(spark, d, "frame_candidates").filter("video_id is not null and frame_number is not null")
    return f.select("video_id", "frame_number", "timestamp_seconds", F.coalesce("is_keyframe", F.lit(False)).alias("key"), "hash", F.coalesce("is_scene_change", F.lit(False)).alias("flagged"))


def _segments(spark, d):
    """Speech made up from the keyframes: each is followed by two and a half seconds of it."""
    k = _frames(spark, d).filter("key and timestamp_seconds is not null")
    return k.select("video_id", c("timestamp_seconds").alias("start_s"), (c("timestamp_seconds") + 2.5).alias("end_s"), F.format_string("line %d", "frame_number").alias("text"))


def scene_changed(spark, d):
    return scene_changes(_frames(spark, d)).drop("hash")


def scene_stats(spark, d):
    return scene_changed(spark, d).groupBy("video_id").agg(F.count("*").alias("frames"), F.count_if("scene").alias("scenes"), F.count_if("duplicate").alias("duplicates"))


def unique_frames(spark, d):
    """Frames that aren't duplicates."""
    return scene_changed(spark, d).filter("not duplicate").select("video_id", "frame_number")


def keyframes(spark, d):
    """The first ten keyframes or frames of a new scene of each video."""
    f = _frames(spark, d).join(scene_changed(spark, d).select("video_id", "frame_number", "scene"), ["video_id", "frame_number"]).filter("key or scene")
    ten = F.slice(F.array_sort(F.collect_list("frame_number")), 1, 10)
    # of a hot video only the ten first of each stretch of frames go on
    f = f.groupBy("video_id", F.shiftright("frame_number", 10).alias("stretch")).agg(ten.alias("few"))
    f = f.select("video_id", F.explode("few").alias("frame_number")).groupBy("video_id").agg(ten.alias("few"))
    return f.select("video_id", F.explode("few").alias("frame_number"))


def scene_sizes(spark, d):
    """Scenes of each video: their first frame and number of frames."""
    return scenes(scene_changes(_frames(spark, d))).groupBy("video_id", "k").agg(F.min("frame_number").alias("first_frame"), F.count("*").alias("frames"))


def scene_representatives(spark, d):
    """Of each scene the frame with the least summed distance to all frames of it; ties go to the first.

    A frame's sum follows from how many of the scene's frames have each of the 64 bits, so no pairs are made.  A scene is
    one piece, however long it is; frames without a hash don't count.
    """
    f = scenes(scene_changes(_frames(spark, d))).filter("hash is not null")
    f = f.select("video_id", "k", "frame_number", vis.half(c("hash"), 1).alias("high"), vis.half(c("hash"), 9).alias("low"))
    bits = [F.shiftright(half, b).bitwiseAND(1) for half in ("high", "low") for b in range(32)]
    sums = f.groupBy("video_id", "k").agg(F.count("*").alias("n"), *[F.sum(bit).alias(f"with{b}") for b, bit in enumerate(bits)])
    far = sum((F.when(bit == 1, c("n") - c(f"with{b}")).otherwise(c(f"with{b}")) for b, bit in enumerate(bits)), F.lit(0))
    near = f.join(sums, ["video_id", "k"]).select("video_id", "k", F.struct(far.alias("bits"), "frame_number").alias("x"))
    return near.groupBy("video_id", "k").agg(F.min("x").alias("x")).select("video_id", "k", "x.frame_number")


def frame_transcript(spark, d):
    """What is said at each frame: the first segment that it lies in."""
    return in_speech(_frames(spark, d), _segments(spark, d))


def transcript_in_range(spark, d):
    """What is said between the tenth and the sixtieth second of each video."""
    return text_within(_segments(spark, d), F.lit(10.0), F.lit(60.0))


def _videos(spark, d):
    return _frames(spark, d).groupBy("video_id").agg(F.max("timestamp_seconds").alias("duration"), F.count("*").alias("frames"))


def planned_frames(spark, d):
    return frame_plan(_videos(spark, d)).select("video_id", "i", F.round("timestamp_seconds", 8).alias("timestamp_seconds"))


def _probe_json():
    stream = F.struct(F.lit("video").alias("codec_type"), F.lit("h264").alias("codec_name"), F.lit(1280).alias("width"), F.lit(720).alias("height"), F.concat(c("frames").cast("string"), F.lit("/8")).alias("r_frame_rate"))
    text = F.to_json(F.struct(F.array(stream).alias("streams"), F.struct(c("duration").cast("string").alias("duration")).alias("format")))
    return F.when(c("frames") % 7 == 0, "{broken").otherwise(text)


def video_metadata(spark, d):
    """Length, size and frames a second out of a media probe's JSON; broken JSON gives nulls."""
    v = _videos(spark, d).select("video_id", vis.video_metadata(_probe_json()).alias("m"))
    return v.select("video_id", r6(c("m.duration")).alias("duration"), "m.width", "m.height", r6(c("m.fps")).alias("fps"), "m.codec", "m.audio")


def process_video(spark, d):
    """Of each video what its processing reports; one without speech has no audio."""
    s = _segments(spark, d).groupBy("video_id").agg(F.count("*").alias("segments"))
    out = scene_stats(spark, d).join(_videos(spark, d).select("video_id", "duration"), "video_id").join(s, "video_id", "left")
    return out.select("video_id", "frames", "scenes", "duplicates", (c("frames") - c("duplicates")).alias("unique"), r6(c("duration")).alias("duration"), F.coalesce("segments", F.lit(0)).alias("segments"), F.when(c("segments").isNull(), "no_audio").otherwise("ok").alias("audio"))


def frame_scores(spark, d):
    """Quality 0.5, more for keyframes, frames flagged as a new scene, and frames in speech."""
    said = in_speech(_frames(spark, d), _segments(spark, d))
    f = _frames(spark, d).join(said, ["video_id", "frame_number"], "left")
    return f.select("video_id", "frame_number", r6(vis.frame_score(F.lit(0.5), c("key"), c("flagged"), c("text").isNotNull())).alias("score"))


def chosen_frames(spark, d):
    return select_frames(frame_scores(spark, d), 8)


def even(spark, d):
    return even_frames(_frames(spark, d).select("video_id", "frame_number"), 8)


def frame_prompt(spark, d):
    """What the description of each picture taken from a video is asked for with."""
    v = own(spark, d, "visual_memories").filter("video_id is not null and frame_number is not null").select("id", "video_id", "frame_number", F.nullif("shared_by", F.lit("")).alias("sharer"))
    f = _frames(spark, d).select("video_id", "frame_number", "timestamp_seconds", "flagged")
    f = f.join(_videos(spark, d).select("video_id", "duration"), "video_id").join(in_speech(_frames(spark, d), _segments(spark, d)), ["video_id", "frame_number"], "left")
    x = v.join(f, ["video_id", "frame_number"]).filter("timestamp_seconds is not null")
    return x.select("id", vis.frame_request(c("timestamp_seconds"), F.coalesce("duration", F.lit(0.0)), c("flagged"), c("sharer"), c("text")).alias("prompt"))


def synthesis_prompt(spark, d):
    """What the summary of each video is asked for with: its pictures in order, and what is said in its first minute."""
    v = own(spark, d, "visual_memories").filter("video_id is not null and frame_number is not null").select("id", "video_id", "frame_number", F.coalesce("description", F.lit("")).alias("description"))
    x = v.join(_frames(spark, d).select("video_id", "frame_number", "timestamp_seconds"), ["video_id", "frame_number"]).filter("timestamp_seconds is not null")
    shots = F.transform(F.array_sort(F.collect_list(F.struct("frame_number", "id", c("timestamp_seconds").alias("at"), "description"))), lambda s: F.struct(s["at"].alias("at"), s["description"].alias("description")))
    x = x.groupBy("video_id").agg(shots.alias("shots")).join(_videos(spark, d), "video_id").join(text_within(_segments(spark, d), F.lit(0.0), F.lit(60.0)), "video_id", "left")
    return x.select("video_id", vis.video_request(c("shots"), c("duration"), c("text")).alias("prompt"))


QUERIES = {f.__name__: f for f in (scene_stats, unique_frames, keyframes, scene_sizes, scene_representatives, frame_transcript, transcript_in_range, video_metadata, process_video, frame_scores, frame_prompt, synthesis_prompt)}
QUERIES |= {"scene_changes": scene_changed, "frame_plan": planned_frames, "select_frames": chosen_frames, "even_frames": even}

_FR = f"f as (select video_id, frame_number, timestamp_seconds t, coalesce(is_keyframe, false) k0, hash, coalesce(is_scene_change, false) sc from {own_sql('frame_candidates', 'timestamp_seconds, is_keyframe, hash, is_scene_change')} where video_id is not null and frame_number is not null)"
_SC = _FR + """, g as (select *, ('0x' || hash)::ubigint h, ('0x' || last_value(hash ignore nulls) over (partition by video_id order by frame_number rows between unbounded preceding and 1 preceding))::ubigint ph from f),
sc as (select video_id, frame_number, hash, h, case when h is not null then bit_count(xor(h, ph))::int end bits, h is not null and (ph is null or bit_count(xor(h, ph)) >= 12) scene, coalesce(bit_count(xor(h, ph)) <= 3, false) duplicate from g),
sk as (select *, sum(case when scene or r = 1 then 1 else 0 end) over (partition by video_id order by frame_number) k from (select *, row_number() over (partition by video_id order by frame_number) r from sc))"""
_SEG = "seg as (select video_id, t a, t + 2.5 b, 'line ' || frame_number text from f where k0 and t is not null)"
_SAID = "said as (select f.video_id, frame_number, arg_min(text, (a, b, text)) text from f join seg on f.video_id = seg.video_id and f.t between a and b group by 1, 2)"
_VID = "vid as (select video_id, max(t) duration, count(*) frames from f group by 1)"
_ROUND = "round_even({x}, 0)::bigint"
_SHAPE = "case when {d} > 0 then " + _ROUND.format(x="t") + " || 's/' || " + _ROUND.format(x="{d}") + " || 's (' || " + _ROUND.format(x="t / {d} * 100.0") + " || '% through)' else " + _ROUND.format(x="t") + " || 's' end"
_Q = lambda s: "'" + s.replace("'", "''") + "'"
_FP, _VP = vis.FRAME_REQUEST.split("%s"), vis.VIDEO_REQUEST.split("%s")
ORACLES = {
    "scene_changes": f"with {_SC} select video_id, frame_number, bits, scene, duplicate from sc",
    "scene_stats": f"with {_SC} select video_id, count(*) frames, count(*) filter (where scene) scenes, count(*) filter (where duplicate) duplicates from sc group by 1",
    "unique_frames": f"with {_SC} select video_id, frame_number from sc where not duplicate",
    "keyframes": f"with {_SC} select video_id, frame_number from sc join f using (video_id, frame_number) where k0 or scene qualify row_number() over (partition by video_id order by frame_number) <= 10",
    "scene_sizes": f"with {_SC} select video_id, k::bigint k, min(frame_number) first_frame, count(*) frames from sk group by 1, 2",
    "scene_representatives": f"with {_SC}, b as (select x.video_id, x.k, x.frame_number, sum(bit_count(xor(x.h, y.h))) bits from sk x join sk y on x.video_id = y.video_id and x.k = y.k and x.h is not null and y.h is not null group by 1, 2, 3) select video_id, k::bigint k, frame_number from b qualify row_number() over (partition by video_id, k order by bits, frame_number) = 1",
    "frame_transcript": f"with {_FR}, {_SEG}, {_SAID} select * from said",
    "transcript_in_range": f"with {_FR}, {_SEG} select video_id, string_agg(text, ' ' order by a, b, text) text from seg where a >= 10 and b <= 60 group by 1",
    "frame_plan": f"with {_FR}, {_VID}, n as (select *, least(ceil(duration), 100)::int n from vid where duration > 0) select video_id, i::int i, round(i * duration / n, 8) timestamp_seconds from n, lateral (select unnest(range(0, n)) i)",
    "video_metadata": f"with {_FR}, {_VID} select video_id, case when frames % 7 <> 0 then round(duration, 6) end duration, case when frames % 7 <> 0 then 1280 end width, case when frames % 7 <> 0 then 720 end height, case when frames % 7 <> 0 then round(frames / 8.0::double, 6) end fps, case when frames % 7 <> 0 then 'h264' end codec, case when frames % 7 <> 0 then false end audio from vid",
    "process_video": f"with {_SC}, {_SEG}, {_VID}, st as (select video_id, count(*) frames, count(*) filter (where scene) scenes, count(*) filter (where duplicate) duplicates from sc group by 1), sg as (select video_id, count(*) n from seg group by 1) select st.*, st.frames - duplicates \"unique\", round(duration, 6) duration, coalesce(n, 0) segments, case when n is null then 'no_audio' else 'ok' end audio from st join vid using (video_id) left join sg using (video_id)".replace("select st.*, st.frames", "select st.video_id, st.frames, scenes, duplicates, st.frames"),
    "frame_scores": f"with {_FR}, {_SEG}, {_SAID} select f.video_id, f.frame_number, round((0.5 + case when k0 then 0.3 else 0 end + case when sc then 0.5 else 0 end + case when text is not null then 0.2 else 0 end)::double, 6) score from f left join said using (video_id, frame_number)",
    "even_frames": f"with {_FR}, n as (select video_id, frame_number, row_number() over (partition by video_id order by frame_number) - 1 i, count(*) over (partition by video_id) n from f) select video_id, frame_number from n where n <= 8 or i = n - 1 or (i % (n // 8) = 0 and i // (n // 8) < 7)",
    "frame_prompt": f"with {_FR}, {_SEG}, {_SAID}, {_VID}, v as (select id, video_id, frame_number, nullif(shared_by, '') sharer from {own_sql('visual_memories', 'video_id, frame_number, shared_by')} where video_id is not null and frame_number is not null), x as (select v.id, t, coalesce(duration, 0) dur, sc, sharer, text from v join f using (video_id, frame_number) join vid using (video_id) left join said using (video_id, frame_number) where t is not null) select id, {_Q(_FP[0])} || {_SHAPE.format(d='dur')} || {_Q(_FP[1])} || case when sc then ' This is a scene change.' else '' end || coalesce(' This was shared by ' || sharer || '.', '') || coalesce(chr(10) || chr(10) || 'Audio at this moment: \"' || text || '\"', '') || {_Q(_FP[4])} prompt from x",
    "synthesis_prompt": f"with {_FR}, {_SEG}, {_VID}, v as (select id, video_id, frame_number, coalesce(description, '') description from {own_sql('visual_memories', 'video_id, frame_number, description')} where video_id is not null and frame_number is not null), o as (select v.*, t, row_number() over (partition by video_id order by frame_number, id) r from v join f using (video_id, frame_number) where t is not null), l as (select video_id, string_agg(chr(10) || 'Frame ' || r || ' (' || {_ROUND.format(x='t')} || 's): ' || description, '' order by r) lines from o group by 1), tr as (select video_id, string_agg(text, ' ' order by a, b, text) text from seg where a >= 0 and b <= 60 group by 1) select video_id, {_Q(_VP[0])} || {_ROUND.format(x='duration')} || {_Q(_VP[1])} || lines || coalesce(chr(10) || chr(10) || 'Transcript:' || chr(10) || '\"' || text || '\"', '') || {_Q(_VP[3])} prompt from l join vid using (video_id) left join tr using (video_id)",
}

_STEP = "t{k} as (select t.video_id, case when b is null then t.taken else list_append(t.taken, b) end taken from t{j} t left join (select x.video_id, arg_max(i, (score, -i)) b from x join t{j} t using (video_id) where len(list_filter(taken, lambda z: abs(i - z) < gap)) = 0 group by 1) u using (video_id))"
ORACLES["select_frames"] = "with s as (" + ORACLES["frame_scores"] + "), y as (select *, row_number() over (partition by video_id order by frame_number) - 1 i, count(*) over (partition by video_id) n from s), x as (select *, case when n > 16 then n // 16 else 1 end gap from y), t0 as (select video_id, case when max(n) > 1 then [0::bigint, max(n) - 1] else [0::bigint] end taken from x group by 1), " + ", ".join(_STEP.format(k=k + 1, j=k) for k in range(6)) + " select x.video_id, frame_number from x join t6 using (video_id) where list_contains(taken, i)"
