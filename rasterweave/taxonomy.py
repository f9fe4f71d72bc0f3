"""The seven land-cover classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Class id, name, red, green, blue. Id 0 marks "no label" and is not a class.
CLASSES = (
    (1, "background", 255, 255, 255),
    (2, "building", 255, 0, 0),
    (3, "road", 255, 255, 0),
    (4, "water", 0, 0, 255),
    (5, "barren", 159, 129, 183),
    (6, "forest", 0, 255, 0),
    (7, "agriculture", 255, 195, 128),
)
IGNORE_ID = 0
CLASS_IDS = tuple(row[0] for row in CLASSES)
SCHEMA = "class_id INT, name STRING, r INT, g INT, b INT"


def taxonomy(spark: SparkSession) -> DataFrame:
    """The dimension table: exactly seven rows, so it may always be broadcast."""
    return spark.createDataFrame(CLASSES, SCHEMA)


def class_names(include_ignore: bool = False) -> Column:
    """Names in id order as an array literal, optionally led by the ignore entry."""
    names = [row[1] for row in CLASSES]
    if include_ignore:
        names = ["ignore", *names]
    return F.array(*[F.lit(name) for name in names])


def class_name(class_id: Column) -> Column:
    """Name of a class id; ids outside the taxonomy print as their number."""
    lookup = F.create_map(*[F.lit(value) for row in CLASSES for value in (row[0], row[1])])
    return F.coalesce(F.try_element_at(lookup, class_id.cast("int")), class_id.cast("string"))


def class_colour(class_id: Column) -> Column:
    """Struct ``r, g, b`` of a class id, NULL outside the taxonomy."""
    lookup = F.create_map(
        *[
            item
            for row in CLASSES
            for item in (
                F.lit(row[0]),
                F.struct(*[F.lit(v).alias(n) for n, v in zip("rgb", row[2:])]),
            )
        ]
    )
    return F.try_element_at(lookup, class_id.cast("int"))


def class_id_of(name: Column) -> Column:
    """Class id of a name, NULL when unknown."""
    lookup = F.create_map(*[F.lit(value) for row in CLASSES for value in (row[1], row[0])])
    return F.try_element_at(lookup, name)


def is_legal_mask_value(value: Column) -> Column:
    """True for the ignore id and the seven class ids."""
    return value.between(IGNORE_ID, CLASS_IDS[-1])


def internal_index(class_id: Column, class_ids: tuple[int, ...] = CLASS_IDS) -> Column:
    """0-based position of an external id in ``class_ids``; NULL for anything else."""
    lookup = F.create_map(*[F.lit(v) for i, c in enumerate(class_ids) for v in (c, i)])
    return F.try_element_at(lookup, class_id.cast("int"))


def each_class(class_ids: tuple[int, ...] = CLASS_IDS) -> Column:
    """Generator producing one row per class: the zero-fill of sparse per-class counts."""
    return F.explode(F.array(*[F.lit(c) for c in class_ids]))
