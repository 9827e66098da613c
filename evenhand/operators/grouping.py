"""Grouping strategies: from raw attributes to the groups that audits compare."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.exprs import half_even
from evenhand.operators.summaries import medians

# Groups that an audit distinguishes
RACE_WB = {"White": "White", "Black or African American": "Black"}
RACE_WBO = RACE_WB | {
    "Asian": "Other",
    "American Indian or Alaska Native": "Other",
    "Native Hawaiian or other Pacific Islander": "Other",
    "Other": "Other",
    "Not Reported": "Other",
}
RACE_WN = {k: "White" if k == "White" else "Non-White" for k in RACE_WBO}
ETHNICITY = {"Hispanic or Latino": "Hispanic", "Not Hispanic or Latino": "Non-Hispanic"}


@dataclass(frozen=True)
class Grouping:
    """A named way to group a column: as it is, by a mapping (other values drop out), or by a function to a Column."""

    name: str
    source: str
    mapping: dict[str, str] | None = None
    binner: object = None
    needs: tuple[str, ...] = field(default=())

    def column(self) -> Column:
        value = F.col(self.source)
        if self.binner is not None:
            return self.binner(value)
        if self.mapping is None:
            return value.cast("string")
        pairs = [x for k, v in self.mapping.items() for x in (F.lit(k), F.lit(v))]
        return F.try_element_at(F.create_map(*pairs), value) if pairs else F.lit(None).cast("string")


def age_bins(age: Column) -> Column:
    """<40, 40-60 and 60+; a null age was redacted for being above 89."""
    return F.when(age.isNull(), "60+").when(age < 40, "<40").when(age < 60, "40-60").otherwise("60+")


def age_halves(age: Column, median: Column) -> Column:
    """Below the median or not; null ages drop out. Labels round halves to even."""
    label = half_even(median).cast("string")
    return F.when(age < median, F.concat(F.lit("<"), label)).when(age >= median, F.concat(F.lit(">="), label))


GROUPINGS = (
    Grouping("sex", "sex"),
    Grouping("race_wb", "race", RACE_WB),
    Grouping("race_wbo", "race", RACE_WBO),
    Grouping("race_wn", "race", RACE_WN),
    Grouping("age_3bin", "age_at_imaging", binner=age_bins),
    Grouping("age_median", "age_at_imaging", binner=lambda a: age_halves(a, F.col("age_median"))),
    Grouping("ethnicity", "ethnicity", ETHNICITY),
)


def with_median_age(df: DataFrame, by: list[str]) -> DataFrame:
    """Add age_median, the median of non-null ages within ``by``; one small row a key is joined back, without moving the rows."""
    return df.join(F.broadcast(medians(df, by, "age_at_imaging", "age_median")), by, "left")


def explode_groups(df: DataFrame, groupings=GROUPINGS) -> DataFrame:
    """One row per input row and grouping that it has a group in: adds grouping and grp."""
    pairs = [F.struct(F.lit(g.name).alias("grouping"), g.column().alias("grp")) for g in groupings]
    out = df.withColumn("_g", F.explode(F.array(*pairs)))
    return out.select("*", "_g.grouping", "_g.grp").drop("_g").filter(F.col("grp").isNotNull())


def comparable(long: DataFrame, key: list[str]) -> DataFrame:
    """Only the groupings with two groups or more."""
    counts = long.select(*key, "grp").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 2").drop("_k")
    return long.join(F.broadcast(counts), key, "left_semi")  # a row a grouping: rows stay where they are, as a key's would fill one task
