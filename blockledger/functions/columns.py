"""Column expressions: object keys, file names, paths, seeded hashes. All stay inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*cols) -> Column:
    """First 32 bits of the md5 of the colon-joined values: repeatable across runs, engines and clusters.

    Never null, so that joining on it adds no filters below a shared exchange.
    """
    text = F.concat_ws(":", *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols])
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(0))


def object_key(half, prefix=None) -> Column:
    """`[prefix/]half/pool/block/generation/length`; `half` is 'meta' or 'data', as text or column."""
    half = half if isinstance(half, Column) else F.lit(half)
    parts = [half, F.col("pool_id"), F.col("block_id"), F.col("gen_stamp"), F.col("length")]
    if prefix:
        parts.insert(0, F.lit(prefix.strip("/")))
    return F.concat_ws("/", *[p.cast("string") for p in parts])


def local_name(half) -> Column:
    """`pool/block_generation.half`, the layout of a directory store; the length is the file's size."""
    return F.concat(F.col("pool_id"), F.lit("/"), F.col("block_id"), F.lit("_"), F.col("gen_stamp"), F.lit(f".{half}"))


def normal_path(path: Column) -> Column:
    """Absolute path without scheme, host, doubled or trailing slashes. Clean paths skip the pattern work."""
    clean = F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("//")) & ~F.endswith(path, F.lit("/"))
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    squeezed = F.regexp_replace(F.concat(F.lit("/"), bare), "/+", "/")
    tidy = F.when(squeezed == "/", squeezed).otherwise(F.regexp_replace(squeezed, "/$", ""))
    return F.when(clean, path).otherwise(tidy)


def _depth(path: Column) -> Column:
    """Number of names in a normal path; the root has none."""
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    return F.when(path == "/", F.lit(0)).otherwise(slashes)


def _above(path: Column, names) -> Column:
    """The first `names` names of a normal path; none is the root."""
    return F.when(names == 0, F.lit("/")).otherwise(F.call_function("substring_index", path, F.lit("/"), names + 1))


def path_ancestors(path: Column) -> Column:
    """The path itself, then its parent, and so on down to the root."""
    path = normal_path(path)
    return F.transform(F.sequence(_depth(path), F.lit(0), F.lit(-1)), lambda names: _above(path, names))


def below_any(path: Column, listed: list[str]) -> Column:
    """Whether the path or a directory above it is one of `listed`, without building the ancestors."""
    path = normal_path(path)
    return F.exists(F.sequence(F.lit(0), _depth(path)), lambda names: _above(path, names).isin(listed))


def parent_path(path: Column) -> Column:
    up = F.regexp_replace(normal_path(path), "/[^/]*$", "")
    return F.when(up == "", F.lit("/")).otherwise(up)


# Fixed value: the text form of a block inside a report line.
BLOCK_TEXT = "ExtendedBlock [poolId=%s, blockId=%d, length=%d, generationStamp=%d]"
BLOCK_PATTERN = r"ExtendedBlock \[poolId=([^,]*), blockId=(-?\d+), length=(-?\d+), generationStamp=(-?\d+)\]"


def block_text() -> Column:
    return F.format_string(BLOCK_TEXT, "pool_id", "block_id", "length", "gen_stamp")


def micros(ts) -> Column:
    """Epoch microseconds of a timestamp column."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def interval_micros(text: str) -> int:
    """'5 seconds' -> 5_000_000; accepts the units a report or schedule uses."""
    units = {
        "microsecond": 1,
        "millisecond": 1_000,
        "second": 1_000_000,
        "minute": 60_000_000,
        "hour": 3_600_000_000,
        "day": 86_400_000_000,
    }
    amount, unit = text.split()
    return int(float(amount) * units[unit.rstrip("s").lower()])


def time_slot(ts_us, width_us: int) -> Column:
    """Number of the slot of `width_us` microseconds that holds an epoch microsecond; exact for whole numbers."""
    ts = F.col(ts_us) if isinstance(ts_us, str) else ts_us
    return ((ts - F.pmod(ts, F.lit(width_us))) / F.lit(width_us)).cast("bigint")
