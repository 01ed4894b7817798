"""Mutual information of continuous features with a class, from distances to nearest neighbours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditlake.functions.expr import dbl, melt
from creditlake.functions.ordering import durable, running_totals

#: Places of a class's order that one task looks at together.
BLOCK = 4096


def digamma(n: Column) -> Column:
    """The digamma function of whole numbers from 1, to double precision: a series ten places up, and the way back."""
    x = n.cast("double") + 10
    back = reduce(lambda a, b: a + b, [1 / (n.cast("double") + i) for i in range(10)])
    z = 1 / (x * x)
    series = z * (F.lit(1 / 12) - z * (F.lit(1 / 120) - z * (F.lit(1 / 252) - z * (F.lit(1 / 240) - z * F.lit(1 / 132)))))
    return F.log(x) - 1 / (2 * x) - series - back


def _radii(points: DataFrame, k: int, block: int) -> DataFrame:
    """points (feature, class, value, n) with class_rows, k (the class's), and r: how far each value's k-th neighbour in
    its class lies, itself not counted.

    A value stands k + 1 times at most, since more copies have radius 0 anyway. Places in a class's order are cut into
    blocks that also hold the k places on either side, so no class is ordered in one task."""
    capped = points.withColumn("some", F.least("n", F.lit(k + 1)))
    placed = durable(running_totals(capped, ["feature", "class"], ["value"], ["some", "n"])).where("all_n > 1")
    first = F.col("cum_some") - F.col("some")
    copies = placed.select("feature", "class", "value", "n", F.col("all_n").alias("class_rows"), F.posexplode(F.sequence(first, F.col("cum_some") - 1)).alias("copy", "place"))
    near = F.array_distinct(F.transform(F.array(F.col("place") - k, F.col("place"), F.col("place") + k), lambda p: F.floor(p / block).cast("long")))
    dealt = copies.withColumn("block", F.explode(near))
    order = Window.partitionBy("feature", "class", "block").orderBy("place")
    value, far = F.col("value"), F.lit(float("inf"))
    down = [F.lit(0.0), *[F.coalesce(value - F.lag("value", j).over(order), far) for j in range(1, k + 1)]]
    up = [F.lit(0.0), *[F.coalesce(F.lead("value", j).over(order) - value, far) for j in range(1, k + 1)]]
    of = [reduce(F.least, [F.greatest(down[j], up[q - j]) for j in range(q + 1)]) for q in range(1, k + 1)]
    own = dealt.withColumn("radii", F.array(*of)).where((F.col("copy") == 0) & (F.floor(F.col("place") / block) == F.col("block")))
    some = F.least(F.lit(k), F.col("class_rows") - 1).cast("int")
    return own.select("feature", "class", "value", "n", "class_rows", some.alias("k"), F.element_at("radii", some).alias("r"))


def neighbour_information(df: DataFrame, features: list[str], target: str, k: int = 3, block: int = BLOCK) -> DataFrame:
    """(feature, mutual_information) by the estimator of nearest neighbours, in nats, at least 0.

    For each row, r is the distance of its k-th neighbour (fewer in a smaller class) among rows of its own class, and m
    the number of rows of any class nearer than r, itself included, or equal to it if r is 0. The estimate is
    psi(N) + mean psi(k) - mean psi(rows of the class) - mean psi(m). Rows without a value or class take no part, nor do
    classes of one row; a feature without rows has no estimate. Equal values are one point with a count.

    Neighbours are looked up in blocks of a class's order, numbers within a radius are differences of running totals, so
    no step compares rows with rows or orders them all in one task."""
    long = melt(df.select(F.col(target).alias("class"), *features), features, ["class"], "feature", "value")
    points = long.where("value is not null and not isnan(value) and class is not null").withColumn("value", dbl("value") + F.lit(0.0))
    points = durable(points.groupBy("feature", "class", "value").agg(F.count(F.lit(1)).alias("n")))
    radii = durable(_radii(points, k, block))
    bounds = F.when(F.col("r") > 0, F.array(F.struct((F.col("value") - F.col("r")).alias("at"), F.lit(2).alias("kind")), F.struct((F.col("value") + F.col("r")).alias("at"), F.lit(0).alias("kind"))))
    bounds = bounds.otherwise(F.array(F.struct(F.col("value").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("value").alias("at"), F.lit(2).alias("kind"))))
    asked = radii.select("feature", F.inline(bounds)).distinct().withColumn("n", F.lit(0).cast("long"))
    counted = radii.groupBy("feature", F.col("value").alias("at")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit(1))
    upto = running_totals(asked.unionByName(counted), ["feature"], ["at", "kind"], ["n"])
    upto = durable(upto.where("kind <> 1").select("feature", "at", "kind", F.col("cum_n").alias("upto"), F.col("all_n").alias("rows")))
    zero = F.col("r") == 0
    rows = radii.withColumns({"low": F.when(zero, F.col("value")).otherwise(F.col("value") - F.col("r")), "low_kind": F.when(zero, 0).otherwise(2),
                              "high": F.when(zero, F.col("value")).otherwise(F.col("value") + F.col("r")), "high_kind": F.when(zero, 2).otherwise(0)})
    for side in ("low", "high"):
        found = upto.select("feature", F.col("at").alias(side), F.col("kind").alias(f"{side}_kind"), F.col("upto").alias(f"{side}_n"), *(["rows"] if side == "low" else []))
        rows = rows.join(found, ["feature", side, f"{side}_kind"])
    weighted = [F.sum(F.col("n") * digamma(c)) for c in (F.col("k"), F.col("class_rows"), F.col("high_n") - F.col("low_n"))]
    sums = rows.groupBy("feature").agg(F.max("rows").alias("rows"), weighted[0].alias("own"), weighted[1].alias("classes"), weighted[2].alias("within"))
    estimate = digamma(F.col("rows")) + (F.col("own") - F.col("classes") - F.col("within")) / F.col("rows")
    return sums.select("feature", F.greatest(estimate, F.lit(0.0)).alias("mutual_information"))
