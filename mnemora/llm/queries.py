"""Queries of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mnemora.sources.shared import read_table


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector: the up to five most similar ones with a cosine of 0.85 or more."""
    from pyspark.sql import functions as F

    from mnemora.llm.neighbours import nearest

    memories = read_table(spark, sf_dir, "memory_embeddings").select(F.concat(F.lit("memory/"), "model").alias("space"), F.col("memory_id").alias("id"), F.col("dimensions").alias("size"), "vector")
    visuals = read_table(spark, sf_dir, "visual_memories").select(F.lit("visual/").alias("space"), "id", F.lit(64).alias("size"), F.col("embedding").alias("vector"))
    found = nearest(memories.unionByName(visuals))
    return found.select(F.substring_index("space", "/", 1).alias("kind"), "id", "neighbour", "cosine", "rank")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return p1_neighbours(spark, sf_dir).select("kind", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def _repeats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All memories: those before the last day as one batch, and that day as the batch of a day."""
    from pyspark.sql import functions as F

    from mnemora.llm.history import NoteHistory
    from mnemora.sources.shared import new_path

    notes = read_table(spark, sf_dir, "memories").select("id", F.col("created_at").alias("at"), "content")
    last = notes.agg(F.max("at")).first()[0]
    history = NoteHistory(spark, new_path(spark, "history"))
    if last is None:
        return notes, history.merge(notes)
    day = last // 86_400_000 * 86_400_000
    found = history.merge(notes.filter(F.col("at") < day))
    return notes, found.union(history.merge(notes.filter(F.col("at") >= day)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _repeats(spark, sf_dir)[1]


def p2_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch (a UTC day): the number of memories and of repeats."""
    from pyspark.sql import functions as F

    notes, found = _repeats(spark, sf_dir)
    days = notes.filter("id is not null").groupBy("id").agg(F.min("at").alias("at"))
    days = days.join(found.withColumn("repeat", F.lit(1)), "id", "left")
    day = F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd").alias("day")
    return days.groupBy(day).agg(F.count("*").alias("memories"), F.count("repeat").alias("repeats"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.frame_runs import frame_runs

    return frame_runs(read_table(spark, sf_dir, "frame_candidates")).select("video_id", "first_frame", "last_frame")


def p3_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mnemora.llm.frame_runs import frame_runs

    runs = frame_runs(read_table(spark, sf_dir, "frame_candidates"))
    return runs.select("video_id", "first_frame", "last_frame", "frames", F.round("duration_s", 3).alias("duration_s"))


def _cut_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mnemora.llm.truncation import cut_texts

    odds = cut_texts(read_table(spark, sf_dir, "memories").select("id", "source", F.col("content").alias("text")))
    return odds.select("id", "source", "cut").filter("id is not null")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut_memories(spark, sf_dir).filter("cut").select("id").distinct()


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source: the number of memories, of those that were cut, and their share."""
    from pyspark.sql import functions as F

    one = _cut_memories(spark, sf_dir).groupBy("id").agg(F.max("source").alias("source"), F.max("cut").alias("cut"))
    return one.groupBy("source").agg(F.count("*").alias("memories"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 6).alias("share"))


def p5_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both texts of every memory with placeholders in place of personal data."""
    from pyspark.sql import functions as F

    from mnemora.llm.personal import personal_data

    found = personal_data(read_table(spark, sf_dir, "memories").filter("id is not null"), read_table(spark, sf_dir, "contacts"))
    return found.select("id", F.size("mentions").alias("mentions"), "content", "gist").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from mnemora.llm.personal import personal_data

    found = personal_data(read_table(spark, sf_dir, "memories").filter("id is not null"), read_table(spark, sf_dir, "contacts"))
    return found.select("id", F.explode("mentions").alias("m")).select("id", "m.field", "m.kind", "m.start_pos").distinct()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.tokens import token_ids

    return token_ids(read_table(spark, sf_dir, "documents"))


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.leaks import leaked_passages

    return leaked_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_passages(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from mnemora.llm.subjects import subjects

    found = subjects(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_subjects"), read_table(spark, sf_dir, "subject_areas"))
    return found.select("doc_id", "subject_id")


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each subject area: the number of documents that it is assigned to."""
    from pyspark.sql import functions as F

    return p9_found(spark, sf_dir).groupBy("subject_id").agg(F.count("*").alias("documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_neighbours": p1_neighbours,
    "p2_found": p2_found,
    "p2_daily": p2_daily,
    "p3_found": p3_found,
    "p3_runs": p3_runs,
    "p4_found": p4_found,
    "p4_sources": p4_sources,
    "p5_found": p5_found,
    "p5_masked": p5_masked,
    "p7_ids": p7_ids,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
