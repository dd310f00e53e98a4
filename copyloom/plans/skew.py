"""Building blocks that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from copyloom.plans.workdir import new_path


def numbered(df: DataFrame, group: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Add the 1-based position of each row in its group, in the given order.

    A window would sort a whole group in one task. Here the rows are range
    partitioned by group and order, so a hot group is cut into many sorted
    pieces; each piece then only needs to know how many rows of its group come
    before it. `order` should be unique in a group. The sorted rows are stored,
    since the pieces must not move between the two reads; pass narrow rows and
    join wide ones afterwards.
    """
    keys = [*group, *order]
    path = new_path(df.sparkSession, "numbered")
    (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_piece", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    placed = df.sparkSession.read.parquet(path)
    pieces = placed.groupBy(*group, "_piece").agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # One row per group and piece: at most as many per group as there are partitions.
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(
        Window.unboundedPreceding, -1
    )
    base = pieces.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_piece").alias("_p"),
        (F.col("_first") - F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias("_base"),
    )
    if not group:
        # As many rows as partitions, so the broadcast does not grow with the data.
        base = F.broadcast(base)
    match = F.col("_piece") == F.col("_p")
    for i, g in enumerate(group):
        match = match & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return placed.join(base, match).select(
        *df.columns, (F.col("_at") - F.col("_base") + 1).alias(name)
    )


def concat_in_order(
    df: DataFrame, keys: list[str], order: str, text: str, block: int = 1024
) -> DataFrame:
    """Concatenate `text` per key in `order`; adds the number of pieces as `n`.

    Works in two steps, blocks of neighbouring positions first, so that the
    pieces of a long text are sorted in many tasks and only the few block
    texts meet in one. (keys, order) must be unique.
    """
    blocks = (
        df.withColumn("_block", F.floor(F.col(order) / block))
        .groupBy(*keys, "_block")
        .agg(
            F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {order})").alias("_text"),
            F.count(text).alias("_n"),
        )
    )
    return blocks.groupBy(*keys).agg(
        F.expr("listagg(_text, '') WITHIN GROUP (ORDER BY _block)").alias(text),
        F.sum("_n").alias("n"),
    )


def _salt(columns: list[str], salts: int) -> Column:
    # From the values, not random: a repeated task must place its rows as before.
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_lookup(
    big: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    salts: int = 16,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Equi-join with a narrow lookup that is unique on `key`, every key spread over `salts` tasks.

    For lookups of a few small columns: their rows are copied `salts` times.
    `spread_by` names the columns that tell the rows of one key apart.
    """
    left = big.withColumn("_salt", _salt(spread_by or big.columns, salts))
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt")
    right = lookup.select("*", copies)
    return left.join(right, [key, "_salt"], how).drop("_salt")
