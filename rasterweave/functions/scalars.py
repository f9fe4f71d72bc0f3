"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shape of an ISO-8601 instant with a mandatory offset, and of a UUID.
ISO_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)$"
)
ISO_ANY = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2}(:?\d{2})?)?)?)?$"
)
UUID_SHAPE = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """Quotient as DOUBLE; undefined (NULL) when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(safe_divide(numerator, denominator), F.lit(0.0))


def round_half_even(value: Column, places: int) -> Column:
    return F.bround(value, places)


def clip(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def finite_or_null(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(~bad, value)


def ignored(value: Column, ignore_ids: tuple[int, ...]) -> Column:
    return value.isin(*ignore_ids) if ignore_ids else F.lit(False)


def normalise_domain(value: Column) -> Column:
    return F.lower(F.trim(value))


def sample_key(split: Column, domain: Column, stem: Column) -> Column:
    return F.concat_ws("-", split, domain, stem)


def tile_key(tile_row: Column, tile_col: Column) -> Column:
    return F.format_string("tile_r%04d_c%04d", tile_row.cast("int"), tile_col.cast("int"))


def transition_key(before: Column, after: Column) -> Column:
    return F.concat_ws("->", before.cast("string"), after.cast("string"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot belongs to the stem."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]*)$", 1)


def has_offset(text: Column) -> Column:
    return text.rlike(ISO_INSTANT)


def parse_instant(text: Column) -> Column:
    """TIMESTAMP of an ISO-8601 text that names its offset; NULL otherwise."""
    return F.when(has_offset(text), F.try_to_timestamp(text))


def format_instant(timestamp: Column) -> Column:
    """ISO-8601 text in UTC of a zone-less UTC timestamp, microseconds only when present."""
    whole = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(timestamp, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def is_uuid(text: Column) -> Column:
    """UUID text; braces, the ``urn:uuid:`` lead and missing dashes are accepted."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^urn:uuid:", ""), r"[{}]", "")
    return F.coalesce(bare.rlike(UUID_SHAPE), F.lit(False))


def is_json_integer(raw: Column, minimum: int | None = None) -> Column:
    """True for the JSON text of an integer: not a boolean, string, fraction or NULL."""
    shape = raw.rlike(r"^-?(0|[1-9][0-9]*)$")
    if minimum is not None:
        # beyond 18 characters the sign alone decides
        large = F.when(F.length(raw) > 18, ~raw.startswith("-")).otherwise(raw.try_cast("long") >= minimum)
        shape = shape & large
    return F.coalesce(shape, F.lit(False))


def timestamp_in_name(stem: Column, modified: Column) -> Column:
    """First ``YYYYMMDDTHHMMSS`` anywhere in the name, else first ``YYYYMMDD``, else ``modified``."""

    def first_match(length: int, shape: str, build) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(stem) - length + 1, F.lit(1)))
        windows = F.transform(starts, lambda i: F.substring(stem, i, length))
        shaped = F.filter(windows, lambda text: text.rlike(shape))
        parsed = F.transform(shaped, build)
        return F.get(F.filter(parsed, lambda t: t.isNotNull()), F.lit(0))

    long = first_match(15, r"^(?!0000)\d{8}T\d{6}$", lambda t: _name_timestamp(t, True))
    short = first_match(8, r"^(?!0000)\d{8}$", lambda t: _name_timestamp(t, False))
    return F.coalesce(long, short, modified.cast("timestamp_ntz"))


def _name_timestamp(text: Column, with_time: bool) -> Column:
    day = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    if with_time:
        clock = F.concat_ws(
            ":", F.substring(text, 10, 2), F.substring(text, 12, 2), F.substring(text, 14, 2)
        )
    else:
        clock = F.lit("00:00:00")
    return F.concat_ws(" ", day, clock).try_cast("timestamp_ntz")


def softmax(logits: Column) -> Column:
    """Probabilities of an array of scores, stable for large scores."""
    top = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - top))

    def shares(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(e, lambda x: x / total))

    return let(exps, shares)


def log_sum_exp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def argmax(values: Column) -> Column:
    """0-based index of the largest element, lowest index on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def unit_draw(seed: int, *keys: Column) -> Column:
    """Reproducible pseudo-random number in [0, 1) from a seed and keys."""
    bits = F.xxhash64(F.lit(seed), *keys)
    return F.pmod(bits, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
