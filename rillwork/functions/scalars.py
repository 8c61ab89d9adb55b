"""Scalar functions as Columns.  A null argument gives null unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and characters that Windows forbids in file names.
RESERVED = ("CON", "PRN", "AUX", "NUL", *[f"COM{i}" for i in range(1, 10)], *[f"LPT{i}" for i in range(1, 10)])
INVALID = r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]+'
KIB = 1024


def sanitized_filename(name: Column) -> Column:
    """Runs of invalid characters become ``_``; spaces and dots at the ends go; what is left empty is ``unnamed``; null too."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), INVALID, "_"), r"^[ .]+|[ .]+$", "")
    return F.when(clean == "", "unnamed").when(F.substring_index(F.upper(clean), ".", 1).isin(*RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def size_text(n: Column) -> Column:
    """Bytes, or KB, MB, GB with two decimals, halves to even."""
    unit = lambda k, name: F.concat(F.format_string("%.2f", F.bround(n / float(KIB**k), 2)), F.lit(f" {name}"))
    return F.when(n >= KIB**3, unit(3, "GB")).when(n >= KIB**2, unit(2, "MB")).when(n >= KIB, unit(1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds as 1:02:03."""
    whole = lambda unit: F.call_function("div", seconds, F.lit(unit))
    return F.format_string("%d:%02d:%02d", whole(3600), whole(60) % 60, seconds % 60)


def canonical_url(url: Column, dropped: tuple[str, ...]) -> Column:
    """The URL without the named query keys, the others sorted, without fragment; as it is if none of the keys occurs."""
    base, query = F.substring_index(F.substring_index(url, "#", 1), "?", 1), F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.substring_index(p, "=", 1).isin(*dropped)))
    return F.when(F.size(kept) == F.size(pairs), url).when(F.size(kept) == 0, base).otherwise(F.concat(base, F.lit("?"), F.array_join(kept, "&")))


def xml_escaped(text: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def xml_unescaped(text: Column) -> Column:
    pairs = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)


def color_number(color: Column) -> Column:
    """#RRGGBB as a number; null if it is anything else."""
    return F.when(color.rlike("^#[0-9A-Fa-f]{6}$"), F.conv(F.substring(color, 2, 6), 16, 10).cast("long"))


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """In lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.]\.([^.]+)$", 1))


def as_millis(t: Column) -> Column:
    """Seconds become milliseconds; milliseconds stay."""
    return F.when(F.abs(t) < 100_000_000_000, t * 1000).otherwise(t)


def retention_cutoff(now_ms: Column, days: int) -> Column:
    return now_ms - days * 86_400_000


def frame_interval(fps: Column) -> Column:
    return F.ceil(F.lit(1000) / fps)


def throttled_limit(n: Column, factor: float) -> Column:
    return F.greatest(F.lit(1), (n * factor).cast("long"))


def progress(done: Column, total: Column) -> Column:
    return F.when(total > 0, done * 100.0 / total).otherwise(F.lit(0.0))


def hysteresis_window(count: Column, interval_ms: Column) -> Column:
    return F.least((F.greatest(count, F.lit(1)) + 1) * F.greatest(interval_ms, F.lit(1000)), F.lit(300_000)).cast("long")


def placeholders_filled(template: Column, values: dict[str, Column]) -> Column:
    return reduce(lambda t, kv: F.replace(t, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1], F.lit(""))), values.items(), template)


def aac_rate_index(config: Column) -> Column:
    """The rate index of an AAC configuration's first two bytes."""
    return F.shiftright(config, 7).bitwiseAND(15)


def aac_channels(config: Column) -> Column:
    return F.shiftright(config, 3).bitwiseAND(15)


def pcr_27mhz(base: Column, extension_ticks: Column) -> Column:
    return base * 300 + extension_ticks


def metric_line(name: str, labels: dict[str, Column], value: Column) -> Column:
    """One line of metrics text."""
    esc = lambda c: F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    inner = F.concat_ws(",", *[F.concat(F.lit(f'{k}="'), esc(v.cast("string")), F.lit('"')) for k, v in labels.items()])
    return F.concat(F.lit(name + "{"), inner, F.lit("} "), value.cast("string"))
