from mnemora.queries.registry import QUERIES


def test_routing_searches_all_rows(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 0), (20, [1.0, 0.05], 0), (40, [-1.0, 0.0], 0), (1, [0.7, 0.7], 0), (2, [-0.2, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.id: (r.match, r.zone) for r in QUERIES["pe_routing"](spark, str(tmp_path)).collect()}
    assert got == {0: (20, "reinforce"), 20: (0, "reinforce"), 40: (None, "new_trace")}
