"""Column expressions: distances, scores, rounding and log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-8
#: What log lines hold that report an accuracy.
ACCURACY_LINES = (r"Accuracy globale\s*:\s*([0-9.]+)%", r"(?i)accuracy=\s*([0-9.]+)%")


def squared_distance(a: Column, b: Column) -> Column:
    """Of two arrays of numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def inverse_distance_scores(distances: Column) -> Column:
    """1 / (d + 1e-8) of each distance, stretched to a sum of 1."""
    raw = F.transform(distances, lambda d: 1 / (d + EPSILON))
    total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + x)
    return F.transform(raw, lambda x: x / total)


def probability_table(names: list[str], distances: Column) -> Column:
    """An array of (class_name, value, percent, distance), the likeliest class first."""
    scores = inverse_distance_scores(distances)
    entry = lambda s, i: F.struct(s.alias("value"), F.element_at(F.array(*[F.lit(n) for n in names]), i + 1).alias("class_name"), F.round(s * 100, 2).alias("percent"), F.round(F.element_at(distances, i + 1), 4).alias("distance"))
    ordered = F.sort_array(F.transform(scores, entry), asc=False)
    return F.transform(ordered, lambda x: F.struct(x["class_name"].alias("class_name"), x["value"].alias("value"), x["percent"].alias("percent"), x["distance"].alias("distance")))


def pseudo_probability(squared: Column, which: int = 0) -> Column:
    """The share of one squared distance in all of them: far from that center is near 1."""
    return F.element_at(squared, which + 1) / (F.aggregate(squared, F.lit(0.0), lambda s, x: s + x) + EPSILON)


def four_decimals(c: str) -> Column:
    return F.format_string("%.4f", F.col(c))


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def file_suffix(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^.]+)$", 1))


def accuracy_of_line(line: str | Column) -> Column:
    """The per cent that a log line reports, or null."""
    line = F.col(line) if isinstance(line, str) else line
    first, second = (F.regexp_extract(line, pattern, 1) for pattern in ACCURACY_LINES)
    number = lambda c: F.when(c == "", None).otherwise(c).try_cast("double")
    return F.coalesce(number(first), number(second))


def report_lines(lines: DataFrame, line: str = "line", order: str = "line_no", group: tuple[str, ...] = ("run",)) -> DataFrame:
    """The lines of a run's log that make up its report, trimmed, in `report`: headings of steps, convergence, inertia,
    accuracy and rows of the tables. Progress and file names go; of blank lines one stays between two that are kept. group:
    the columns that tell runs apart, for a run's lines are ordered in one task."""
    text = F.regexp_replace(F.col(line), r"^\s+|\s+$", "")
    # fixed values: the words of a run's log
    low = F.lower(text)
    drop = low.contains("analyse images") | text.startswith("...") | low.contains("pipeline termin") | low.contains("fichiers génér") | low.contains("sauvegard")
    heading = text.contains("ETAPE") | text.contains("ÉTAPE") | text.contains("Classification MRI") | text.contains("Segmentation avanc")
    figures = text.contains("Convergence") | low.contains("inertie=") | text.contains("images ×") | text.contains("Accuracy globale")
    table = text.rlike(r"^(Classe|tumor|no_tumor|Cluster K-Means|Cluster 0|Cluster 1|-+$)")
    w = Window.partitionBy(*group).orderBy(order)
    kept = lines.withColumn("report", text).filter(~drop & (heading | figures | table | (text == "")))
    kept = kept.withColumn("_before", F.lag("report").over(w)).withColumn("_after", F.max(F.col("report") != "").over(w.rowsBetween(1, Window.unboundedFollowing)))
    return kept.filter((F.col("report") != "") | ((F.col("_before") != "") & F.col("_after"))).drop("_before", "_after")
