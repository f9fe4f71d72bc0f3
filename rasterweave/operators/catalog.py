"""Dataset catalogue: from a file listing to validated (image, mask) samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterweave.functions import scalars as S
from rasterweave.functions.prefix import first_rows
from rasterweave.session import checkpoint
from rasterweave.taxonomy import IGNORE_ID, is_legal_mask_value

# Directory names and suffixes recognised in a labelled image tree. Where several
# names exist side by side the first one listed wins.
SPLITS = ("train", "val", "test")
DOMAINS = ("urban", "rural")
SPLIT_ALIASES = {
    "train": ("Train", "train"),
    "val": ("Val", "val", "Valid", "valid", "validation"),
    "test": ("Test", "test"),
}
DOMAIN_ALIASES = {"urban": ("Urban", "urban"), "rural": ("Rural", "rural")}
IMAGE_DIRS = ("images_png", "images", "img")
MASK_DIRS = ("masks_png", "masks", "labels", "gt")
IMAGE_SUFFIXES = (".png", ".tif", ".tiff", ".jpg", ".jpeg")


def _lookup(pairs: list[tuple[str, object]], key: Column) -> Column:
    items = [F.lit(v) for pair in pairs for v in pair]
    return F.try_element_at(F.create_map(*items), key)


def _canonical(aliases: dict[str, tuple[str, ...]], key: Column) -> Column:
    return _lookup([(alias, name) for name, group in aliases.items() for alias in group], key)


def _rank(aliases: dict[str, tuple[str, ...]] | tuple[str, ...], key: Column) -> Column:
    groups = aliases.values() if isinstance(aliases, dict) else (aliases,)
    return _lookup([(alias, i) for group in groups for i, alias in enumerate(group)], key)


def _layout_pattern() -> str:
    def choice(names) -> str:
        return "|".join(names)

    splits = choice(a for group in SPLIT_ALIASES.values() for a in group)
    domains = choice(a for group in DOMAIN_ALIASES.values() for a in group)
    # an extra level is taken only where the plain layout does not fit
    return (
        f"^(?:([^/]+)/)??({splits})/(?:([^/]+)/)??({domains})/({choice(IMAGE_DIRS + MASK_DIRS)})/([^/]+)$"
    )


def parse_paths(paths: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Split file paths under ``root`` into directory roles.

    Recognised: ``[extra/]split/[extra/]domain/kind/file``. Adds ``top``, ``split_dir``,
    ``inner``, ``domain_dir``, ``kind_dir``, ``file``, ``stem``, ``suffix``, ``split``, ``domain``
    and ``role`` (image or mask); other paths are dropped.
    """
    base = root.rstrip("/") + "/"
    pattern = _layout_pattern()
    p = F.col(path)
    relative = F.substring(p, F.lit(len(base) + 1), F.length(p))
    names = ("top", "split_dir", "inner", "domain_dir", "kind_dir", "file")
    rows = paths.where(p.startswith(base) & relative.rlike(pattern)).select(
        "*", *[F.regexp_extract(relative, pattern, i).alias(n) for i, n in enumerate(names, start=1)]
    )
    return rows.select(
        "*",
        S.file_stem(F.col("file")).alias("stem"),
        S.file_suffix(F.col("file")).alias("suffix"),
        _canonical(SPLIT_ALIASES, F.col("split_dir")).alias("split"),
        _canonical(DOMAIN_ALIASES, F.col("domain_dir")).alias("domain"),
        F.when(F.col("kind_dir").isin(*IMAGE_DIRS), "image").otherwise("mask").alias("role"),
    )


def _winning_directories(files: DataFrame) -> DataFrame:
    """Keep, at every level, only the files of the directory that is first in alias order.

    The choice is made on the distinct directories. It leaves one directory per split, domain and
    role, at most twelve rows, which are then broadcast to the files.
    """
    levels = ["top", "split_dir", "inner", "domain_dir", "kind_dir"]
    orders = (
        ([], F.struct(F.col("top") != "", F.col("top"))),
        (["split"], F.struct(_rank(SPLIT_ALIASES, F.col("split_dir")))),
        (["split"], F.struct(F.col("inner") != "", F.col("inner"))),
        (["split", "domain"], F.struct(_rank(DOMAIN_ALIASES, F.col("domain_dir")))),
        (
            ["split", "domain", "role"],
            F.struct(F.coalesce(_rank(IMAGE_DIRS, F.col("kind_dir")), _rank(MASK_DIRS, F.col("kind_dir")))),
        ),
    )
    keys = ["split", "domain", "role", *levels]
    # directories that fit the layout, not files: few enough for the levels to share one task
    chosen = files.select(*keys).distinct().repartition(1)
    for group, order in orders:
        peers = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        chosen = chosen.withColumn("_at", order)
        chosen = chosen.withColumn("_best", F.min("_at").over(peers)).where("_at = _best").drop("_at", "_best")
    return files.join(F.broadcast(chosen), keys)


def pair_masks(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Left join images to masks of the same split, domain and stem.

    The mask with the image's exact file name wins, otherwise the first by path. Several masks per
    stem are reduced by ``min_by`` before the join, so the join is one-to-one on the stem.
    """
    keys = ["split", "domain", "stem"]
    per_stem = masks.groupBy(*keys).agg(
        F.min_by("path", "path").alias("_first"),
    )
    exact = masks.groupBy(*keys, "file").agg(F.min("path").alias("_exact"))
    return (
        images.join(exact, [*keys, "file"], "left")
        .join(per_stem, keys, "left")
        .withColumn("mask_path", F.coalesce("_exact", "_first"))
        .drop("_exact", "_first")
    )


def scan_paths(paths: DataFrame, root: str, with_aliases: bool = True) -> DataFrame:
    """Manifest of a file listing: ``sample_id, split, domain, image_path, mask_path``."""
    files = parse_paths(paths, root)
    if with_aliases:
        files = _winning_directories(files)
    # the listing is read once and its parsed form three times
    files = checkpoint(files.select("path", "file", "stem", "suffix", "split", "domain", "role"))
    images = files.where((F.col("role") == "image") & F.lower("suffix").isin(*IMAGE_SUFFIXES))
    masks = files.where(F.col("role") == "mask")
    return pair_masks(images.drop("role"), masks.drop("role", "suffix")).select(
        S.sample_key(F.col("split"), F.col("domain"), F.col("stem")).alias("sample_id"),
        "split",
        "domain",
        F.col("path").alias("image_path"),
        "mask_path",
    )


def directory_problems(paths: DataFrame, root: str) -> DataFrame:
    """Domain directories that hold masks or other files but no usable image."""
    files = parse_paths(paths, root)
    usable = (F.col("role") == "image") & F.lower("suffix").isin(*IMAGE_SUFFIXES)
    return (
        files.groupBy("split", "domain")
        .agg(F.count_if(usable).alias("images"))
        .where("images = 0")
        .select("split", "domain", F.lit("no image files").alias("problem"))
    )


def filter_manifest(samples: DataFrame, **wanted: str | None) -> DataFrame:
    """Restrict a manifest by ``split`` and ``domain``; a name that cannot occur is an error."""
    legal = {"split": SPLITS, "domain": DOMAINS}
    for column, value in wanted.items():
        if value is None:
            continue
        if value not in legal[column]:
            raise ValueError(f"{column} has no value {value!r}, only {', '.join(legal[column])}")
        samples = samples.where(F.col(column) == value)
    return samples


def missing_labels(samples: DataFrame) -> DataFrame:
    """Samples outside the test split that lack a mask."""
    return samples.where(F.col("mask_path").isNull() & (F.col("split") != "test"))


def require_labels(samples: DataFrame) -> DataFrame:
    """The manifest itself, failing the job when a train or val sample lacks its mask."""
    bad = F.col("mask_path").isNull() & (F.col("split") != "test")
    message = F.concat(F.lit("sample without mask: "), F.col("sample_id").cast("string"))
    return samples.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True))


def manifest_order() -> list[Column]:
    """train, val, test; urban before rural; path ascending."""

    def position(names: tuple[str, ...], column: str) -> Column:
        return F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))

    return [position(SPLITS, "split"), position(DOMAINS, "domain"), F.col("image_path").asc()]


def manifest_stats(samples: DataFrame) -> DataFrame:
    """Counts in total, per split and per domain from one pass over the manifest."""
    return (
        samples.groupingSets([[], ["split"], ["domain"]], "split", "domain")
        .agg(
            F.count("*").alias("samples"),
            F.count_if(F.col("mask_path").isNull()).alias("missing_masks"),
            F.grouping_id().alias("_gid"),
        )
        .select(
            F.when(F.col("_gid") == 3, "total")
            .when(F.col("_gid") == 1, "split")
            .otherwise("domain")
            .alias("level"),
            F.coalesce("split", "domain", F.lit("all")).alias("name"),
            "samples",
            "missing_masks",
        )
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def size_mismatches(dimensions: DataFrame) -> DataFrame:
    """Issues for samples whose image and mask sizes differ; reads only the size columns."""
    pair = F.format_string(
        "image/mask size mismatch: (%d, %d) vs (%d, %d)",
        "image_width", "image_height", "mask_width", "mask_height",
    )
    differs = (F.col("image_width") != F.col("mask_width")) | (
        F.col("image_height") != F.col("mask_height")
    )
    return dimensions.where(differs).select("sample_id", pair.alias("problem"))


def illegal_values(pixels: DataFrame, value: str = "target_id") -> DataFrame:
    """One issue per sample listing its distinct mask values outside 0..7.

    Rows are reduced to distinct (sample, value) first; 8-bit masks leave at most 248 of those
    per sample.
    """
    return (
        pixels.where(~is_legal_mask_value(F.col(value)))
        .select("sample_id", F.col(value).alias("_v"))
        .distinct()
        .groupBy("sample_id")
        .agg(F.array_sort(F.collect_list("_v")).alias("_values"))
        .select(
            "sample_id",
            F.concat(
                F.lit("invalid mask pixel values: ["),
                F.array_join(F.transform("_values", lambda v: v.cast("string")), ", "),
                F.lit("]"),
            ).alias("problem"),
        )
    )


def unreadable(headers: DataFrame) -> DataFrame:
    """Issues for headers that carry a decode error (``sample_id, kind, error``)."""
    return headers.where("error IS NOT NULL").select(
        "sample_id", F.format_string("unreadable %s: %s", "kind", "error").alias("problem")
    )


def validate(
    samples: DataFrame,
    dimensions: DataFrame,
    pixels: DataFrame | None = None,
    headers: DataFrame | None = None,
    max_samples: int | None = None,
) -> DataFrame:
    """All ``(sample_id, problem)`` rows of a manifest.

    ``pixels=None`` leaves the pixel pass out of the plan. ``max_samples`` restricts the check to
    the first samples in manifest order.
    """
    issues = size_mismatches(dimensions)
    if headers is not None:
        issues = issues.unionByName(unreadable(headers))
    if pixels is not None:
        issues = issues.unionByName(illegal_values(pixels))
    if max_samples is not None:
        first = first_rows(samples, manifest_order(), max_samples).select("sample_id")
        issues = issues.join(first, "sample_id", "left_semi")
    return issues


def class_histogram(pixels: DataFrame, value: str = "target_id") -> DataFrame:
    """Pixels and percentage per mask value, without the ignore id but with illegal values."""
    counts = (
        pixels.where(F.col(value) != IGNORE_ID)
        .groupBy(F.col(value).alias("class_id"))
        .agg(F.count("*").alias("pixels"))
    )
    total = counts.agg(F.sum("pixels")).scalar()
    return counts.withColumn("percent", 100.0 * F.col("pixels") / total)
