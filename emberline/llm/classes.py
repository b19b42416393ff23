"""What the near-duplicate operators share: classes of equal items have numbers, ids are values they carry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.runtime import cut


def smallest_of_components(roots: DataFrame, values: DataFrame) -> DataFrame:
    """(rep, value): the smallest value of the component of each class that has a link.

    ``roots`` is (id, component) of the classes that are not their component's smallest number,
    ``values`` (rep, value) of all classes. A component with a third of all classes is partly
    aggregated before it is shuffled, and its result reaches them by a plain join.
    """
    roots = cut(roots.select(F.col("id").alias("rep"), "component"))
    members = cut(roots.unionByName(roots.select(F.col("component").alias("rep"), "component").distinct()).join(values, "rep"))
    least = cut(members.groupBy("component").agg(F.min("value").alias("value")))
    return members.select("rep", "component").join(least, "component").select("rep", "value")
