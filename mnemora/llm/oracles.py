"""SQL for the queries of this subpackage that SQL can express."""

_FRAMES = """
with f as (
  select video_id, frame_number, max(timestamp_seconds) t, max(hash) h, max(is_duplicate) d, max(distance_from_previous) p
  from frame_candidates where video_id is not null and frame_number is not null group by 1, 2
), g as (
  select *, lag(h) over w ph, lag(frame_number) over w pf from f window w as (partition by video_id order by frame_number)
), r as (
  select *, coalesce(pf is not null and case when p is not null then p <= 3
    when h is not null and ph is not null then bit_count(xor(('0x' || h)::ubigint, ('0x' || ph)::ubigint)) <= 3
    else d end, false) rep from g
), n as (
  select *, sum(case when rep then 0 else 1 end) over (partition by video_id order by frame_number) k from r
), u as (
  select video_id, min(frame_number) first_frame, max(frame_number) last_frame, count(*) frames,
         round(max(t) - min(t), 3) duration_s
  from n group by video_id, k having count(*) > 1
)
"""

ORACLES: dict[str, str] = {
    "p3_found": _FRAMES + "select video_id, first_frame, last_frame from u",
    "p3_runs": _FRAMES + "select video_id, first_frame, last_frame, frames, duration_s from u",
}
