"""Writers for splits, reports and generated plans; Spark's committer does the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators.splits import SEED, shuffled_positions

# Fixed value: plans per output file.
PLANS_PER_FILE = 20_000


def write_splits(records: DataFrame, folder: str, plans_per_file: int = PLANS_PER_FILE) -> None:
    """Records with a ``split`` column as JSON files of bounded size, one folder per split."""
    writer = records.write.partitionBy("split").option("maxRecordsPerFile", plans_per_file)
    writer.mode("errorifexists").json(folder)


def write_shuffled(
    records: DataFrame, key: Column, folder: str, plans_per_file: int = PLANS_PER_FILE, seed: int = SEED
) -> None:
    """Records in a seeded shuffle, as JSON files of ``plans_per_file`` records each; the last one may have fewer.

    A record's place in the shuffle tells its file, and each file is a task of its own that sorts and writes it. Files are
    numbered in the order of the shuffle, and so are their names; equal inputs give equal files whatever the partitioning,
    as long as keys are distinct.
    """
    files = max(-(-records.count() // plans_per_file), 1)
    place = "_place"
    placed = shuffled_positions(records, key, seed, place)
    number = F.floor(F.col(place) / plans_per_file).cast("int")
    dealt = placed.repartitionById(files, number).sortWithinPartitions(place).drop(place)
    dealt.write.mode("errorifexists").json(folder)


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    df.write.mode("errorifexists").csv(folder, header=True)


def write_generated(generated: DataFrame, folder: str, per_file: int = PLANS_PER_FILE) -> None:
    """Generated plans, one ``<n>_actions`` folder per number of given actions."""
    named = generated.withColumn("given", F.concat(F.col("actions_seen").cast("string"), F.lit("_actions")))
    writer = named.write.partitionBy("given").option("maxRecordsPerFile", per_file)
    writer.mode("errorifexists").json(folder)
