"""Tags as a table of entities, attributes and values: defaults, registry joins, whitelists and a readable report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_tags(rows: DataFrame, keys: list[str], tags: dict[int, Column]) -> DataFrame:
    """A row for each key and tag: keys, tag and value, without a shuffle."""
    pairs = F.array(*[F.struct(F.lit(t).cast("long").alias("tag"), v.alias("value")) for t, v in tags.items()])
    return rows.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.tag", "p.value")


def with_defaults(tags: DataFrame, wanted: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted (keys, tag) with their values, or the tag's default."""
    found = wanted.join(tags, [*keys, "tag"], "left").join(F.broadcast(defaults), "tag", "left")
    return found.select(*keys, "tag", F.coalesce("value", "default_value").alias("value"))


def unknown(tags: DataFrame, registry: DataFrame) -> DataFrame:
    """Tags that the registry doesn't have; a registry has a row for each of at most 65,536 tags, so it is broadcast."""
    return tags.join(F.broadcast(registry.select("tag").distinct()), "tag", "left_anti")


def whitelisted(tags: DataFrame, whitelist: DataFrame) -> DataFrame:
    return tags.join(F.broadcast(whitelist.select("tag").distinct()), "tag", "left_semi")


def merge_registry(registry: DataFrame, more: DataFrame) -> DataFrame:
    """The registry and those of the further fields whose tag and type it doesn't have."""
    return registry.unionByName(more.join(registry, ["tag", "type"], "left_anti"))


def sorted_registry(registry: DataFrame, out: str = "position") -> DataFrame:
    """Places by tag, then type in descending order; at most 65,536 tags of 18 types meet in the one window."""
    return registry.withColumn(out, F.row_number().over(Window.orderBy("tag", F.col("type").desc())).cast("long") - 1)


def rational(numerator: Column, denominator: Column) -> Column:
    """A quotient in single precision; a denominator of 0 gives 1."""
    return F.when(denominator != 0, (numerator.cast("float") / denominator.cast("float")).cast("float")).otherwise(F.lit(1.0).cast("float"))


def to_rational(value: Column) -> Column:
    """numerator and denominator of a number that isn't negative, scaled by 8 while both stay below 2^28; negative ones give 0 / 1."""
    scaled = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct((value * F.pow(F.lit(8.0), k)).alias("n"), F.pow(F.lit(8.0), k).cast("long").alias("d"))), lambda x: (x["n"] < 2**28) & (x["d"] < 2**28))
    exact = F.filter(scaled, lambda x: x["n"] == F.floor(x["n"]))
    best = F.when(F.size(exact) > 0, exact[0]).when(F.size(scaled) > 0, F.element_at(scaled, -1))
    return F.when(value < 0, F.struct(F.lit(0).cast("long").alias("numerator"), F.lit(1).cast("long").alias("denominator"))).otherwise(F.struct(F.floor(best["n"] + 0.5).cast("long").alias("numerator"), best["d"].alias("denominator")))


def ascii_text(raw: Column) -> Column:
    """The Latin-1 text of a payload up to its first NUL."""
    return F.substring_index(F.decode(raw, "ISO-8859-1"), "\0", 1)


def printable(text: Column) -> Column:
    """The text with characters outside the printable ones as three octal digits after a backslash."""
    parts = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[\\x20-\\x7e]$") | (c == ""), c).otherwise(F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(c).cast("string"), 10, 8), 3, "0"))))
    return F.array_join(parts, "")


def pdf_literal(text: Column) -> Column:
    """Parentheses and backslashes escaped for a PDF string, other odd characters as octal."""
    return F.regexp_replace(printable(F.regexp_replace(text, r"\\", r"\\\\")), r"([()])", r"\\$1")


def pdf_date(time: Column) -> Column:
    return F.concat(F.lit("D:"), F.date_format(time, "yyyyMMddHHmmss"))


def parse_date(text: Column) -> Column:
    """A timestamp from "YYYY:MM:DD HH:MM:SS", null if it isn't one."""
    return F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy:MM:dd HH:mm:ss"))


def directory_line(name: Column, value: Column) -> Column:
    return F.concat(F.lit("  "), name, F.lit(": "), F.coalesce(value, F.lit("(null)")))


def directory_text(lines: Column) -> Column:
    """The lines of an array of (tag, line) by tag, ended by CR LF."""
    return F.concat(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\r\n"), F.lit("\r\n"))


def print_directory(tags: DataFrame, keys: list[str], names: Column, out: str = "report") -> DataFrame:
    """One text for each directory, "name: value" by tag, lines ended by CR LF."""
    gathered = tags.groupBy(*keys).agg(F.collect_list(F.struct("tag", directory_line(names, F.col("value").cast("string")).alias("line"))).alias("lines"))
    return gathered.select(*keys, directory_text(F.col("lines")).alias(out))
