"""Names and labels: run identifiers, chunk tags, padded file names, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_decimals(d: Column) -> Column:
    """A number with two decimals and "dot" for its point."""
    return F.replace(F.format_string("%.2f", d.cast("double")), F.lit("."), F.lit("dot"))


def replace_first(s: Column, old: str, new: str) -> Column:
    at = F.instr(s, old)
    return F.when(at > 0, F.concat(F.substring(s, F.lit(1), at - 1), F.lit(new), F.substring(s, at + len(old), F.length(s)))).otherwise(s)


def split_tag(tag: Column) -> list[Column]:
    parts = F.split(tag, "_")
    return [parts[i].cast("bigint") for i in range(3)]


def padded_name(n: Column, width: int = 5, extension: str = "") -> Column:
    """n with zeros before it up to `width` digits; longer numbers stay whole."""
    digits = n.cast("string")
    return F.concat(F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0"), F.lit(extension))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def with_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit("." + extension))


def clock_folder(ts: Column) -> Column:
    return F.date_format(ts, "HH-mm-ss_dd-MM-yyyy")


def run_identifier(resolution: int, update_distance: float, max_distance: float, max_weight: int, size: tuple[int, int, int], comment: str = "", refinement: bool = True, prefix: str = "run-int") -> str:
    """Name of a map file from its parameters; numbers have two decimals with "dot" for the point."""
    dec = lambda d: f"{d:.2f}".replace(".", "dot", 1)
    middle = f"_{comment}_" if comment else "_"
    fine = "ref_" if refinement else ""
    return f"{prefix}{middle}{fine}res-{resolution}_upd_d-{dec(update_distance)}_max_d-{dec(max_distance)}_max_w-{max_weight}_map-{size[0]}x{size[1]}x{size[2]}"
