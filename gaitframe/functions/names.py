"""Clip names, labels from paths, and short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaitframe.schema import LANDMARK_NAMES, SHOT_CLASSES, SPLITS, VIDEO_EXTENSIONS


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot starts no extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?/*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def _resolved(path: Column) -> Column:
    """Parts of a path without ``.`` and ``..``."""
    up = F.lit("..")
    return F.aggregate(parts(path), F.array().cast("array<string>"), lambda to, x: F.when(x == up, F.slice(to, 1, F.greatest(F.size(to) - 1, F.lit(0)))).otherwise(F.concat(to, F.array(x))))


def relative_path(path: Column, start: Column) -> Column:
    """The path as seen from the folder ``start``; as it is where one is absolute and the other not, or their schemes differ."""
    root = r"^([A-Za-z][A-Za-z0-9+.-]*:/+|/?)"
    p, s = _resolved(path), _resolved(start)
    other = F.array_position(F.zip_with(p, s, lambda a, b: a.eqNullSafe(b)), False).cast("int")
    common = F.when(other > 0, other - 1).otherwise(F.size(p))
    steps = F.concat(F.array_repeat(F.lit(".."), F.size(s) - common), F.slice(p, common + 1, F.size(p)))
    seen = F.when(F.size(steps) > 0, F.array_join(steps, "/")).otherwise(".")
    return F.when(F.regexp_extract(path, root, 1) == F.regexp_extract(start, root, 1), seen).otherwise(path)


def shown_path(path: Column, root: Column) -> Column:
    """The path below ``root``; as it is where it lies elsewhere."""
    seen = relative_path(path, root)
    return F.when(seen.rlike(r"^\.\.(/|$)"), path).otherwise(seen)


def video_id(path: Column) -> Column:
    return F.coalesce(F.nullif(stem(path), F.lit("")), F.lit("unknown_video"))


def landmark_name(index: Column) -> Column:
    return F.coalesce(F.get(F.split(F.lit(",".join(LANDMARK_NAMES)), ","), F.when(index >= 0, index)), F.concat(F.lit("unknown_"), index.cast("string")))


def parts(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def archive_labels(member: Column) -> tuple[Column, Column]:
    """(split, type) of an archive member: what follows the first split name, else a known class."""
    p = F.transform(parts(member), F.lower)
    known = F.array(*map(F.lit, SPLITS))
    at = F.array_position(F.transform(p, lambda x: F.array_contains(known, x)), True)
    split = F.get(p, F.when(at > 0, at - 1).cast("int"))
    follows = F.coalesce(F.get(p, at.cast("int")), F.lit("unknown"))
    scanned = F.coalesce(F.get(F.array_intersect(F.array(*map(F.lit, SHOT_CLASSES)), p), F.lit(0)), F.lit("unknown"))
    return (
        F.when(at > 0, F.when(split == "validation", "val").otherwise(split)).otherwise("unknown"),
        F.when(at > 0, follows).otherwise(scanned),
    )


def sample_labels(relative: Column) -> tuple[Column, Column]:
    """(split, type) of a sampled clip by the depth of its relative path."""
    p = parts(relative)
    n = F.size(p)
    return F.when(n >= 3, F.get(p, F.lit(0))).otherwise("unknown"), F.when(n >= 3, F.get(p, F.lit(1))).when(n == 2, F.get(p, F.lit(0))).otherwise("unknown")


def safe_id(split: Column, kind: Column, path: Column) -> Column:
    """``split_type_stem`` with every run of other characters as one underscore."""
    return F.regexp_replace(F.concat_ws("_", split, kind, stem(path)), r"[^A-Za-z0-9_-]+", "_")


def is_video(path: Column) -> Column:
    """By extension; side-car files and macOS folders do not count."""
    return extension(path).isin(*VIDEO_EXTENSIONS) & ~file_name(path).startswith("._") & ~F.array_contains(F.split(path, "/"), "__MACOSX")


def without_suffix(name: Column, suffix: str) -> Column:
    """Name without the suffix, else its stem."""
    return F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(stem(name))


def short_metric(name: Column) -> Column:
    for old in ("_proxy", "_deg", "mean_", "max_", "min_"):
        name = F.replace(name, F.lit(old), F.lit(""))
    return F.replace(name, F.lit("_"), F.lit(" "))


def shown(value: Column, digits: int = 4) -> Column:
    """A number with fixed digits, ``N/A`` for null."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)).otherwise("N/A")


def json_between_braces(log: Column, schema: str) -> Column:
    """The object between a log's first and last brace."""
    return F.from_json(F.regexp_extract(log, r"(?s)\{.*\}", 0), schema)


def without_images(markdown: Column) -> Column:
    """Markdown without its image lines and the blank line after each."""
    kept = F.regexp_replace(F.concat(markdown, F.lit("\n")), r"(?m)(?:^[ \t]*!\[[^\n]*\]\([^\n]*\)[ \t]*\n)+(?:[ \t]*\n)?", "")
    return F.concat(F.regexp_replace(kept, r"^\s+|\s+$", ""), F.lit("\n"))
