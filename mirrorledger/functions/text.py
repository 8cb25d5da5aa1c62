"""Texts for reports: sizes, labels, escaping."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .paths import extension


def _scaled(size: Column, unit: int, decimals: int, suffix: str) -> Column:
    return F.format_string(f"%.{decimals}f {suffix}", size / F.lit(float(unit)))


def byte_size(size: Column) -> Column:
    """``0 B`` for negatives, then B, KB and MB with one decimal, GB and TB with two."""
    return (
        F.when(size < 0, "0 B")
        .when(size >= K.TIB, _scaled(size, K.TIB, 2, "TB"))
        .when(size >= K.GIB, _scaled(size, K.GIB, 2, "GB"))
        .when(size >= K.MIB, _scaled(size, K.MIB, 1, "MB"))
        .when(size >= K.KIB, _scaled(size, K.KIB, 1, "KB"))
        .otherwise(F.format_string("%d B", size))
    )


def report_size(size: Column) -> Column:
    """Whole KB, MB with one decimal, GB with two; no TB."""
    return (
        F.when(size >= K.GIB, _scaled(size, K.GIB, 2, "GB"))
        .when(size >= K.MIB, _scaled(size, K.MIB, 1, "MB"))
        .when(size >= K.KIB, _scaled(size, K.KIB, 0, "KB"))
        .otherwise(F.format_string("%d B", size))
    )


def capacity_size(size: Column) -> Column:
    return (
        F.when(size >= K.TIB, _scaled(size, K.TIB, 1, "TB"))
        .when(size >= K.GIB, _scaled(size, K.GIB, 1, "GB"))
        .when(size >= K.MIB, _scaled(size, K.MIB, 1, "MB"))
        .when(size >= K.KIB, _scaled(size, K.KIB, 0, "KB"))
        .otherwise(F.format_string("%d B", size))
    )


def item_size(size: Column) -> Column:
    """MB from one MiB on, KB below, one decimal."""
    return F.when(size >= K.MIB, _scaled(size, K.MIB, 1, "MB")).otherwise(_scaled(size, K.KIB, 1, "KB"))


def certificate_size(size: Column, unit: str = "MB") -> Column:
    return _scaled(size, K.GIB if unit == "GB" else K.MIB, 2, unit)


def extension_label(path: Column) -> Column:
    return F.upper(extension(path))


def destination_label(root_path: Column, dest_id: Column) -> Column:
    return F.when(F.trim(F.coalesce(root_path, F.lit(""))) == "", dest_id).otherwise(root_path)


def guard_formula(text: Column) -> Column:
    """Spreadsheets run quoted fields that look like formulas, so those get a leading apostrophe."""
    return F.when(F.substring(text, 1, 1).isin(K.FORMULA_TRIGGERS), F.concat(F.lit("'"), text)).otherwise(text)


def csv_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(guard_formula(text), F.lit('"'), F.lit('""')), F.lit('"'))


def html(text: Column) -> Column:
    escaped = text
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        escaped = F.replace(escaped, F.lit(raw), F.lit(entity))
    # The upper Latin-1 range is written as numeric references.
    numeric = F.array_join(
        F.transform(
            F.split(escaped, ""),
            lambda c: F.when(F.ascii(c).between(160, 255), F.concat(F.lit("&#"), F.ascii(c).cast("string"), F.lit(";")))
            .otherwise(c),
        ),
        "",
    )
    return F.when(escaped.rlike("[\\x{A0}-\\x{FF}]"), numeric).otherwise(escaped)


def grouped_number(value: Column) -> Column:
    return F.format_number(value, 0)


def mode_label(mode: Column) -> Column:
    label = mode
    for name, text in K.MODE_LABELS.items():
        label = F.when(mode == name, text).otherwise(label)
    return label


def verdict_badge(verdict: Column, missing: Column, corrupt: Column) -> Column:
    unsafe = F.concat(
        F.lit("UNSAFE TO FORMAT - "), grouped_number(missing), F.lit(" MISSING, "), grouped_number(corrupt),
        F.lit(" CORRUPT"),
    )
    return (
        F.when(verdict == "SafeToFormat", "SAFE TO FORMAT - ALL MEDIA VERIFIED")
        .when(verdict == "PartiallyBackedUp", "PARTIALLY BACKED UP - ATTENTION REQUIRED")
        .when(verdict == "NoMediaFound", "NO MEDIA DETECTED - DO NOT FORMAT")
        .otherwise(unsafe)
    )


def verdict_banner(verdict: Column, total: Column, full: Column, partial: Column, missing: Column, corrupt: Column):
    """The short banner with the backed-up percentage."""
    need = F.when(partial == 1, "1 NEEDS").otherwise(F.format_string("%d NEED", partial))
    percent = F.format_string("%.0f", backup_percentage(total, full, partial))
    return (
        F.when(verdict == "SafeToFormat", "SAFE TO FORMAT - 100% BACKED UP")
        .when(
            verdict == "PartiallyBackedUp",
            F.concat(F.lit("PARTIALLY BACKED UP - 100% SINGLE COPY ("), need, F.lit(" REDUNDANCY)")),
        )
        .when(verdict == "NoMediaFound", "NO MEDIA DETECTED - DO NOT FORMAT")
        .otherwise(
            F.concat(
                F.lit("UNSAFE TO FORMAT - "), percent, F.lit("% BACKED UP ("),
                (missing + corrupt).cast("string"), F.lit(" UNPROTECTED)"),
            )
        )
    )


def backup_percentage(total: Column, full: Column, partial: Column) -> Column:
    return F.when(total > 0, (full + partial) / total * 100.0).otherwise(F.lit(0.0))


def verdict_colour(verdict: Column) -> Column:
    colour = F.lit(K.VERDICT_COLOURS["UnsafeToFormat"])
    for name in ["SafeToFormat", "PartiallyBackedUp", "NoMediaFound"]:
        colour = F.when(verdict == name, K.VERDICT_COLOURS[name]).otherwise(colour)
    return colour


def redundancy_type(intra: Column, cross: Column) -> Column:
    return (
        F.when(intra & cross, "Same-Drive and Multi-Drive")
        .when(intra, "Same-Drive Duplicate")
        .otherwise("Multi-Drive Redundant")
    )


def redundancy_badge(intra: Column, cross: Column) -> Column:
    return (
        F.when(intra & cross, "SAME-DRIVE WASTE & MULTI-DRIVE")
        .when(intra, "SAME-DRIVE DUPLICATE WASTE")
        .otherwise("MULTI-DRIVE REDUNDANCY")
    )


def copy_badge(same_destination_duplicate: Column, is_primary: Column) -> Column:
    return F.when(~same_destination_duplicate, "BACKUP COPY").when(is_primary, "PRIMARY").otherwise("DUPLICATE")


def best_checksum(full_fp: Column, deep_fp: Column, head_fp: Column, hex_form) -> Column:
    """Strongest known fingerprint with a note on weaker kinds; ``-`` when none is known."""
    return (
        F.when(full_fp.isNotNull(), hex_form(full_fp))
        .when(deep_fp.isNotNull(), F.concat(hex_form(deep_fp), F.lit(" (Deep)")))
        .when(head_fp.isNotNull(), F.concat(hex_form(head_fp), F.lit(" (Head)")))
        .otherwise("-")
    )


def exposure_time(numerator: Column, denominator: Column) -> Column:
    seconds = numerator / denominator
    # Unknown parts need a branch of their own: formatting null would print "n".
    return (
        F.when(numerator.isNull() | denominator.isNull() | (denominator == 0), None)
        .when(numerator == 0, "0s")
        .when(numerator < denominator, F.format_string("1/%.0fs", F.rint(denominator / numerator)))
        .otherwise(F.format_string("%.1fs", seconds))
    )


def aperture(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, F.format_string("f/%.1f", numerator / denominator))


def focal_length(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, F.format_string("%.0fmm", numerator / denominator))


def iso_text(iso: Column) -> Column:
    return F.when(iso > 0, F.concat(F.lit("ISO "), iso.cast("string")))


def dimensions(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), F.concat_ws(" × ", width.cast("string"), height.cast("string")))


def camera_summary(has_exif: Column, make: Column, model: Column) -> Column:
    def blank(text):
        return F.trim(F.coalesce(text, F.lit(""))) == ""

    prefixed = F.upper(model).startswith(F.upper(make))
    return (
        F.when(~has_exif, "Unknown Camera")
        .when(~blank(model) & ~blank(make) & ~prefixed, F.concat_ws(" ", make, model))
        .when(~blank(model), model)
        .otherwise(F.coalesce(make, F.lit("Unknown Camera")))
    )


def exposure_summary(has_exif: Column, focal: Column, f_number: Column, exposure: Column, iso: Column) -> Column:
    joined = F.concat_ws(" • ", focal, f_number, exposure, iso)
    return (
        F.when(~has_exif, "No EXIF exposure metadata available")
        .when(joined != "", joined)
        .otherwise("Metadata present")
    )


def capture_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))
