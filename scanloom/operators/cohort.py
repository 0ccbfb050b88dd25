"""Which images make up a cohort: labels, counts, ordered and best-first selection, stratified splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File endings that an upload may have.
UPLOAD_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".jfif", ".webp")
SEED = 42


def binary_label(df: DataFrame, class_column: str = "class_name") -> DataFrame:
    """df with binary: 1 if the class name holds `no_tumor`, else 0."""
    return df.withColumn("binary", F.when(F.lower(class_column).contains("no_tumor"), 1).otherwise(0))


def resolve_class_dirs(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(class_name, dir): the first directory by name whose lower-case name holds the expected name or is held by it.

    `notumor` may also be a directory with `no` and `tumor`, `normal` or `healthy` in its name. Both tables have one row
    per class. A class without a directory has null."""
    low, names = F.lower("dir"), F.col("class_name")
    direct = expected.join(found, low.contains(names) | names.contains(low)).groupBy("class_name").agg(F.min("dir").alias("dir"))
    spare = expected.filter("class_name = 'notumor'").join(found, (low.contains("no") & low.contains("tumor")) | low.contains("normal") | low.contains("healthy")).groupBy("class_name").agg(F.min("dir").alias("spare"))
    return expected.join(direct, "class_name", "left").join(spare, "class_name", "left").select("class_name", F.coalesce("dir", "spare").alias("dir"))


def only_class(df: DataFrame, classes: DataFrame, name: str, class_column: str = "class_name") -> DataFrame:
    """The rows of one class; an unknown class is an error."""
    if not classes.filter(F.col("class_name") == name).limit(1).count():
        raise ValueError(f"unknown class: {name}")
    return df.filter(F.col(class_column) == name)


def class_counts(files: DataFrame, classes: DataFrame, class_column: str = "class_name") -> DataFrame:
    """(class_id, class_name, n) of all files, whatever their suffix; a class without files has 0."""
    counts = files.groupBy(F.col(class_column).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(counts, "class_name", "left").select("class_id", "class_name", F.coalesce("n", F.lit(0)).alias("n"))


def binary_class_counts(files: DataFrame, class_column: str = "class_name") -> DataFrame:
    none = F.lower(class_column).contains("no_tumor")
    counts = files.agg(F.count_if(~none).alias("tumor"), F.count_if(none).alias("no_tumor"))
    return counts.select(F.expr("stack(2, 'tumor', tumor, 'no_tumor', no_tumor) as (class_name, n)"))


def split_class_counts(files: DataFrame, split_column: str = "split", class_column: str = "class_name") -> DataFrame:
    """(split, class_name, n) with totals: a null stands for all."""
    return files.rollup(F.col(split_column).alias("split"), F.col(class_column).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


def coin(id_column: str | Column, seed: int = SEED) -> Column:
    """A repeatable hash of an id as 32 hexadecimal digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(id_column) if isinstance(id_column, str) else id_column).cast("string")))


def first_per_class(df: DataFrame, class_column: str, name_column: str, n: int, path_column: str | None = None) -> DataFrame:
    """The first n files of each class by lower-case name, then path, with their place `nth`.

    Spark turns the limit on the rank into a limit per task before the shuffle, so a large class costs n rows a task."""
    order = [F.lower(name_column), F.col(path_column or name_column)]
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(class_column).orderBy(*order))).filter(F.col("nth") <= n)


def select_best(df: DataFrame, class_column: str, id_column: str, score_column: str, n: int, keep: float = 0.8, seed: int = SEED) -> DataFrame:
    """The n best rows of each class by score, where each row counts with chance `keep` by a coin of its id, and the
    others only fill up what is missing, best first: one order by (kept, score, id) does both. Only pass narrow rows."""
    heads = F.substring(coin(id_column, seed), 1, 8) >= F.lit(f"{round((1 - keep) * 0xFFFFFFFF):08x}")
    order = Window.partitionBy(class_column).orderBy(F.desc("kept"), F.desc(score_column), id_column)
    return df.withColumn("kept", heads).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n)


def unselected(df: DataFrame, chosen: DataFrame, id_column: str) -> DataFrame:
    """The rows that weren't chosen."""
    return df.join(chosen.select(id_column), id_column, "left_anti")


def stratified_split(df: DataFrame, class_column: str, id_column: str, ratio: float = 0.2, seed: int = SEED) -> DataFrame:
    """df with split: of each class exactly max(1, floor(n * ratio)) rows are `test`, those with the least coins.

    Few large classes would make few large sorts. So rows are first counted by class and the coin's first digits; whole
    groups below the cut go to the test side, and only the one group that holds the cut is ranked."""
    rows = df.withColumn("_coin", coin(id_column, seed)).withColumn("_head", F.substring("_coin", 1, 4))
    counts = rows.groupBy(class_column, "_head").agg(F.count(F.lit(1)).alias("_n"))
    by_head = Window.partitionBy(class_column).orderBy("_head").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(class_column)
    cuts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(by_head), F.lit(0))).withColumn("_cut", F.greatest(F.lit(1), F.floor(F.sum("_n").over(whole) * F.lit(ratio))))
    cuts = cuts.filter(F.col("_before") < F.col("_cut")).filter(F.col("_before") + F.col("_n") >= F.col("_cut")).select(F.col(class_column).alias("_class"), F.col("_head").alias("_last"), (F.col("_cut") - F.col("_before")).alias("_room"))
    placed = rows.join(F.broadcast(cuts), F.col(class_column).eqNullSafe(F.col("_class")))  # one row per class
    ranked = placed.filter("_head = _last").select(F.col(id_column).alias("_id"), "_class", "_coin", "_room").withColumn("_rank", F.row_number().over(Window.partitionBy("_class").orderBy("_coin", "_id"))).filter("_rank <= _room")
    edge = placed.join(ranked.select("_id", F.lit(True).alias("_in")), F.col(id_column) == F.col("_id"), "left")
    test = (F.col("_head") < F.col("_last")) | ((F.col("_head") == F.col("_last")) & F.col("_in").isNotNull())
    return edge.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def accepted_uploads(df: DataFrame, path_column: str = "path") -> DataFrame:
    """The rows whose file ending, in any case, is one of an image."""
    return df.filter(is_accepted(path_column))


def is_accepted(path_column: str) -> Column:
    return F.lower(F.regexp_extract(path_column, r"(\.[^.]+)$", 1)).isin(*UPLOAD_SUFFIXES)


def distinct_labels(df: DataFrame, label: str = "label") -> DataFrame:
    return df.select(label).distinct()
