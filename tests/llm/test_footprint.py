"""What the operators leave on disk and how many tasks they take, beside their results."""

from pathlib import Path

from pyspark.sql import functions as F

from gatewaylens import session
from gatewaylens.llm import prefix_trie


def test_shuffles_of_a_written_table_are_gone_when_it_is_written(spark):
    folder = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])

    def shuffled() -> set:
        return {f for f in folder.rglob("shuffle_*") if f.is_file()}

    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before = shuffled()
    rows.write.parquet(session.new_path(spark, "plain"))
    assert shuffled() - before
    before = shuffled()
    made = session.written(rows, "test")
    assert not shuffled() - before
    assert made.agg(F.count("*"), F.sum("count")).first() == (7, 1000)
    assert spark.conf.get(session.SHUFFLE_CLEANUP_CONF) == "false"


def test_levels_of_the_trie_are_few_files_however_many_partitions_a_shuffle_has(spark, monkeypatch):
    files = {}

    def recorded(rows, name):
        made = session.written(rows, name)
        files.setdefault(name, []).append(len(made.inputFiles()))
        return made

    monkeypatch.setattr(prefix_trie, "written", recorded)
    turns = spark.createDataFrame(
        [(c, t, f"role{t % 2}", f"text {t if t < 3 else c}") for c in range(1, 200) for t in range(c % 9)], "conv_id long, turn int, role string, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        found = prefix_trie.prefix_trie(*prefix_trie.rebuilt(prefix_trie.coded_turns(turns), F.lit(0), F.col("conv"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # Three shared turns, then each conversation's own.
    lengths = [c % 9 for c in range(1, 200)]
    assert len(found) == 1 + 3 + sum(max(0, n - 3) for n in lengths)
    assert max(n for name in ("blocks", "cut", "edges", "block-totals", "totals", "nodes", "ends") for n in files[name]) <= prefix_trie.LEAST_TASKS
