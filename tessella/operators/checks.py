"""Checks of directories and tags as column expressions: what may be set, what is consistent, what can be converted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, jpeg  # noqa: F401  jpeg adds its codecs

#: Tags whose number of values can't be changed once an image has data; pseudo tags are above the 16 bits of a tag.
PSEUDO = 65536


def field_error(tag: Column, value: Column) -> Column:
    """Why a value can't be set for a tag, or null."""
    return (
        F.when((tag == 274) & ~value.between(1, 8), "an orientation is 1 to 8")
        .when((tag == 266) & ~value.isin(1, 2), "a fill order is 1 or 2")
        .when((tag == 284) & ~value.isin(1, 2), "a planar configuration is 1 or 2")
        .when(tag.isin(322, 323) & (F.pmod(value, F.lit(16)) != 0), "the sides of a tile are multiples of 16")
        .when(tag.isin(277, 278, 32998) & (value == 0), "the value can't be 0")
        .when((tag == 296) & ~value.between(1, 3), "a resolution unit is 1 to 3")
        .when((tag == 339) & ~value.between(1, 6), "a sample format is 1 to 6")
        .when((tag == 317) & ~value.between(1, 3), "a predictor is 1 to 3")
    )


def is_pseudo(tag: Column) -> Column:
    return tag >= PSEUDO


def valid_extra_samples(extra: Column, samples: Column) -> Column:
    """Extra samples with the faulty 999 of some writers as unassociated alpha; null if there are more than samples or one is unknown."""
    patched = F.transform(extra, lambda x: F.when(x == 999, 2).otherwise(x))
    return F.when((F.size(extra) <= samples) & F.forall(patched, lambda x: x.between(0, 2)), patched)


def valid_ink_names(names: Column, samples: Column) -> Column:
    """Whether NUL-separated ink names are as many as the samples."""
    return F.size(F.array_remove(F.split(names, "\\x00"), "")) == samples


def trimmed_count(values: Column, expected: Column) -> Column:
    """Values of a tag with more of them than expected are cut; with fewer the tag doesn't count."""
    return F.when(F.size(values) >= expected, F.slice(values, F.lit(1), expected))


def is_old_jpeg(compression: Column, tags: Column) -> Column:
    """Whether JPEG data are of the old style: compression 7 with any of the old style's tags."""
    return (compression == codecs.JPEG) & F.arrays_overlap(tags, F.array(*[F.lit(t) for t in (512, 513, 514, 515, 519, 520, 521)]))


def rgba_error(dirs: DataFrame) -> Column:
    """Why a directory's image can't be converted to RGBA, or null; takes the columns of the table of directories."""
    bits, samples, photometric = dirs["bits_per_sample"], dirs["samples_per_pixel"], dirs["photometric"]
    colors = samples - F.coalesce(F.size(dirs["extra_samples"]), F.lit(0))
    return (
        F.when(~dirs["compression"].isin(codecs.configured_schemes()), "the compression isn't configured")
        .when(~bits.isin(1, 2, 4, 8, 16), "the bits of a sample aren't 1, 2, 4, 8 or 16")
        .when(photometric.isin(0, 1, 3) & (dirs["planar"] == 1) & (samples != 1) & (bits < 8), "several samples need 8 bits")
        .when((photometric == 3) & dirs["colormap"].isNull(), "the colour map is missing")
        .when((photometric == 2) & (colors < 3), "RGB needs 3 samples")
        .when((photometric == 5) & ((samples < 4) | (bits != 8)), "separated images need 4 samples of 8 bits")
        .when((photometric == 6) & ((samples < 3) | (bits != 8)), "YCbCr needs 3 samples of 8 bits")
        .when((photometric == 8) & ((samples != 3) | (bits != 8)), "CIE L*a*b* needs 3 samples of 8 bits")
        .when(~photometric.isin(0, 1, 2, 3, 5, 6, 8), "the photometric interpretation isn't converted")
    )


def codec_table(spark: SparkSession) -> DataFrame:
    """scheme, name and whether it is configured, and whether a user's codec goes before the built-in one."""
    user = codecs.registered()
    rows = [(s, codecs.NAMES.get(s, "user"), codecs.is_configured(s), s in user) for s in sorted({*codecs.NAMES, *user})]
    return spark.createDataFrame(rows, "scheme int, name string, configured boolean, user boolean")
