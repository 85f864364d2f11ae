import random

from mnemora.operators.frames import select_frames


def greedy(scores, most):
    n = len(scores)
    gap = n // (2 * most) if n > 2 * most else 1
    taken = [0, n - 1][: min(n, 2)] if most >= 2 else []
    for i in sorted(range(n), key=lambda i: (-scores[i], i)):
        if len(taken) < most and all(abs(i - t) >= gap for t in taken):
            taken.append(i)
    return sorted(taken)


def test_select_frames_against_brute_force(spark):
    r = random.Random(8)
    videos = {}
    for k, n in enumerate((1, 2, 3, 7, 16, 17, 50, 400, 575, 900, 1300)):
        videos[f"flat{k}"] = [r.choice([0.5, 0.7, 0.8, 1.0]) for _ in range(n)]
        high = [r.randrange(n) for _ in range(5)]
        videos[f"bursts{k}"] = [1.0 if any(0 <= i - h < 30 for h in high) else 0.5 for i in range(n)]
    rows = [(v, i, s) for v, scores in videos.items() for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "video_id string, frame_number int, score double")
    for most in (1, 2, 4, 8):
        got = {}
        for x in select_frames(df, most).collect():
            got.setdefault(x.video_id, []).append(x.frame_number)
        assert {v: sorted(f) for v, f in got.items()} == {v: greedy(s, most) for v, s in videos.items()}
