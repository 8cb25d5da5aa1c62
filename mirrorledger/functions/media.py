"""Media categories and filter presets over a file extension column."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import (
    CATEGORY_LABELS,
    PRESETS,
    RAW_PHOTO_EXTENSIONS,
    SIDECAR_EXTENSIONS,
    STANDARD_PHOTO_EXTENSIONS,
    VIDEO_EXTENSIONS,
)


def one_of(text: Column, values: list[str]) -> Column:
    """Ignore-case membership in a fixed list, as one anchored pattern instead of a literal per entry."""
    return text.rlike("(?i)^(?:" + "|".join(re.escape(v) for v in values) + r")\z")


def category_of(extension: Column) -> Column:
    return (
        F.when(one_of(extension, RAW_PHOTO_EXTENSIONS), "PhotoRaw")
        .when(one_of(extension, STANDARD_PHOTO_EXTENSIONS), "PhotoStandard")
        .when(one_of(extension, VIDEO_EXTENSIONS), "Video")
        .when(one_of(extension, SIDECAR_EXTENSIONS), "Sidecar")
        .otherwise("Other")
    )


def in_preset(extension: Column, preset: str | None) -> Column:
    """Whether a preset admits the extension. ``None`` admits every file that has one."""
    if preset is None:
        return extension != ""
    return one_of(extension, PRESETS[preset])


def category_label(category: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, text in CATEGORY_LABELS.items():
        label = F.when(category == name, text).otherwise(label)
    return label
