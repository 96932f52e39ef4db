"""Quality of predictions: counts, rates, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("SECRET", "NOT_SECRET", "UNSURE")


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 9)


def _counts() -> list[Column]:
    hit, said = F.col("label") == "SECRET", F.col("prediction") == "SECRET"
    return [F.count_if(hit & said).alias("tp"), F.count_if(~hit & said).alias("fp"), F.count_if(hit & ~said).alias("fn")]


def secret_rates(df: DataFrame, *sets: str) -> DataFrame:
    """True and false positives, precision and recall of SECRET for each value of each column, in one pass."""
    grouped = df.groupingSets([[c] for c in sets], *sets).agg(*_counts(), *(F.grouping(c).alias(f"g_{c}") for c in sets))
    level = F.coalesce(*(F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in sets))
    value = F.coalesce(*(F.when(F.col(f"g_{c}") == 0, F.col(c)) for c in sets))
    return grouped.select(level.alias("level"), value.alias("value"), "tp", "fp", "fn", _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), _rate(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def confusion(df: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Predictions by label, a column for each prediction."""
    return df.groupBy("label").pivot("prediction", list(labels)).count().na.fill(0)


def report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each label."""
    sides = df.select(F.explode(F.array(F.struct(F.col("label").alias("name"), F.lit(1).alias("is_label")), F.struct(F.col("prediction").alias("name"), F.lit(0).alias("is_label")))).alias("s"), (F.col("label") == F.col("prediction")).alias("right"))
    out = sides.groupBy(F.col("s.name").alias("name")).agg(F.sum("s.is_label").alias("support"), F.sum(1 - F.col("s.is_label")).alias("said"), F.count_if((F.col("s.is_label") == 1) & F.col("right")).alias("tp"))
    p, r = F.try_divide("tp", "said"), F.try_divide("tp", "support")
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return out.select(F.col("name").alias("label"), "support", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 9).alias("f1"))


def gates(df: DataFrame, least: dict[str, float]) -> DataFrame:
    """Recall of each label against what it must reach."""
    rows = report(df).where(F.col("label").isin(*least))
    need = F.coalesce(*(F.when(F.col("label") == k, F.lit(v)) for k, v in least.items()))
    return rows.select("label", "recall", need.alias("needed"), (F.col("recall") >= need).alias("passed"))


def errors(df: DataFrame, most: int = 50, key: str = "doc_id") -> DataFrame:
    """The first errors of each kind, and how many more there are."""
    kind = F.concat(F.col("label"), F.lit(">"), F.col("prediction"))
    w = Window.partitionBy("kind")
    rows = df.where("label <> prediction").withColumn("kind", kind)
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy(key))).withColumn("total", F.count("*").over(w))
    return rows.where(F.col("rank") <= most).select("kind", "rank", key, F.greatest(F.col("total") - most, F.lit(0)).alias("more"))


def balanced_weights(df: DataFrame) -> DataFrame:
    """Count and weight of each label: n / (k * n_label)."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.join(F.broadcast(total)).select("label", "n", F.round(F.col("total") / (F.col("k") * F.col("n")), 9).alias("weight"))
