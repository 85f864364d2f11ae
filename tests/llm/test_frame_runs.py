import random

from mnemora.llm.frame_runs import frame_runs

SCHEMA = "video_id string, frame_number int, timestamp_seconds double, hash string, is_duplicate boolean, distance_from_previous int, _cell string, first_frame int"


def brute(rows):
    by = {}
    for v, n, t, h, d, p, *_ in rows:
        if v is not None and n is not None:
            by.setdefault(v, {})[n] = (t, h, d, p)
    out = set()
    for v, frames in by.items():
        numbers = sorted(frames)
        run = [numbers[0]]
        for a, b in zip(numbers, numbers[1:]):
            t, h, d, p = frames[b]
            if p is not None:
                same = p <= 3
            elif h is not None and frames[a][1] is not None:
                same = bin(int(h, 16) ^ int(frames[a][1], 16)).count("1") <= 3
            else:
                same = bool(d)
            if same:
                run.append(b)
            else:
                if len(run) > 1:
                    out.add((v, run[0], run[-1]))
                run = [b]
        if len(run) > 1:
            out.add((v, run[0], run[-1]))
    return out


def test_against_brute_force_over_cells(spark):
    r = random.Random(4)
    rows = []
    for v in ("a", "b", "hot"):
        h = 0
        for n in range(400 if v == "hot" else 40):
            if r.random() < 0.3:
                h = r.getrandbits(64)
            else:
                h ^= 1 << r.randrange(64)
            rows.append((v, n * (3 if v == "b" else 1), n * 0.5, f"{h:016x}" if r.random() > 0.2 else None, r.choice([True, False, None]), r.choice([None, None, 0, 2, 3, 4, 20]), "x", 9))
    rows += rows[:20]  # delivered again
    rows += [(None, 3, 1.0, None, True, 0, "x", 1), ("a", None, 1.0, None, True, 0, "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bits in ((11, 10), (2, 2), (1, 3)):
        got = {tuple(x)[:3] for x in frame_runs(df, cell_bits=bits[0], level_bits=bits[1]).collect()}
        assert got == brute(rows)


def test_empty_and_null_times(spark):
    assert frame_runs(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("v", k, None if k < 9 else 4.0, None, True, None, "", 0) for k in range(3)]
    got = frame_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.first_frame, r.last_frame, r.frames, r.duration_s) for r in got] == [(0, 2, 3, None)]
