import random

from mnemora.queries.registry import QUERIES


def test_representative_of_a_long_scene(spark, tmp_path):
    r = random.Random(3)
    hashes = [r.getrandbits(64)]
    for _ in range(449):
        hashes.append(hashes[-1] ^ sum(1 << b for b in r.sample(range(64), 4)))
    rows = [("v", k, float(k), False, f"{h:016x}", False) for k, h in enumerate(hashes)] + [("w", 0, 0.0, False, "00000000000000ff", False)]
    spark.createDataFrame(rows, "video_id string, frame_number int, timestamp_seconds double, is_keyframe boolean, hash string, is_scene_change boolean").write.parquet(f"{tmp_path}/frame_candidates.parquet")
    got = [(x.video_id, x.k, x.frame_number) for x in QUERIES["scene_representatives"](spark, str(tmp_path)).collect()]
    sums = [sum((h ^ o).bit_count() for o in hashes) for h in hashes]
    assert sorted(got) == [("v", 1, sums.index(min(sums))), ("w", 1, 0)]
