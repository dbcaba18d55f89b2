"""The three tools as functions and as commands: copy, conversion to RGBA, and PDF.

    python -m tessella.tools copy [options] IN[,PAGE...] ... OUT
    python -m tessella.tools rgba [options] IN ... FOLDER
    python -m tessella.tools pdf [options] IN ... FOLDER
    python -m tessella.tools info IN ...
"""

from __future__ import annotations

import argparse
import dataclasses
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codecs, image
from .sources import pdf, sink, tiff

#: A bias image of more bytes isn't sent along with the code; subtract it by a join of sample tables (operators.relayout).
BIAS_BYTES = 64 << 20


def parse_input(text: str, separator: str = ",") -> tuple[str, list[int] | None, int | None]:
    """Path, pages, and the first of the pages from which on all count: "a.tif", "a.tif,0,2" or "a.tif,1,"."""
    path, *rest = text.split(separator)
    if not rest:
        return path, None, None
    if rest[-1] == "":
        numbers = [int(x) for x in rest[:-1] if x]
        return path, numbers[:-1], numbers[-1] if numbers else 0
    return path, [int(x) for x in rest], None


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    """position, path and content of files, in the order of the paths."""
    out = None
    for i, p in enumerate(paths):
        one = spark.read.format("binaryFile").load(p).select(F.lit(i).cast("long").alias("position"), "path", "content")
        out = one if out is None else out.unionByName(one)
    return out


@dataclass
class Changed:
    """A change of pages that can be sent to tasks."""

    layout: sink.WriteOptions
    no_alpha: bool = False
    rgba: bool = False
    bias: np.ndarray | None = None
    rotate: int = 0
    crop: tuple[int, int, int, int] | None = None
    renumber: bool = False

    def __call__(self, page: sink.Page) -> sink.Page:
        a = page.array
        if self.bias is not None:
            if a.shape != self.bias.shape or a.shape[2] != 1 or page.bits not in (8, 16, 32):
                raise ValueError("a bias image has the size of the image, one sample and 8, 16 or 32 bits")
            a = (a.astype(np.int64) - self.bias) % (1 << page.bits)
        if self.crop:
            y, x, h, w = self.crop
            a = a[y : y + h, x : x + w]
        if self.rotate:
            a = np.ascontiguousarray(np.rot90(a, -self.rotate // 90))
        page = dataclasses.replace(page, array=a)
        if self.rgba:
            m = image.Meta(a.shape[1], a.shape[0], page.bits, a.shape[2], page.sample_format, page.photometric, extra_samples=page.extra_samples, colormap=page.colormap)
            out = image.to_rgba(a, m)
            page = dataclasses.replace(page, array=out[..., :3] if self.no_alpha else out, photometric=image.RGB, bits=8, sample_format=1, extra_samples=[] if self.no_alpha else [1], colormap=[], subsampling=(1, 1))
        elif self.layout.planar == 2 and page.bits != 8 and page.array.shape[2] > 1 and page.photometric == image.YCBCR:
            raise ValueError("planes of YCbCr need 8 bits")
        return page


def copy(
    spark: SparkSession, inputs: list[str], output: str | None = None, options: sink.WriteOptions | None = None, append: bool = False, bias: str | None = None, separator: str = ",", rotate: int = 0,
    crop: tuple[int, int, int, int] | None = None, ignore: bool = False, offset: int | None = None, renumber: bool = False,
) -> DataFrame:
    """Copies pages of files, in the order given, into one file. Gives path and content, and writes to `output` if there is one.

    `append` puts them after the pages that the output has. `bias` is a file, and a page of it ("file,2", else the first), that is subtracted from each page.
    `ignore` goes on after chunks that can't be read, `offset` begins with the directory at this place in each file, and `renumber` numbers the pages anew.
    """
    options = options or sink.WriteOptions()
    change = Changed(options, rotate=rotate, crop=crop) if bias or rotate or crop or not options.keep_layout else None
    if bias:
        path, pages, onward = parse_input(bias, separator)
        frame = load(spark, [path]).first()
        array, _ = tiff.arrays(bytes(frame["content"]), pages[0] if pages else onward or 0)
        if array.nbytes > BIAS_BYTES:
            raise ValueError("the bias image is too large to be sent along; subtract it by operators.relayout.subtract_bias")
        change.bias = array.astype(np.int64)
    parts = None
    given = ([output] if append and output else []) + inputs
    for i, text in enumerate(given):
        own = append and output and i == 0
        path, pages, onward = (text, None, None) if own else parse_input(text, separator)
        one = load(spark, [path])
        numbers = pages
        if onward is not None or offset is not None and not own:
            found = tiff.Tiff(one).dirs().where("kind = 'main'").select("ifd", "ifd_offset").orderBy("ifd").collect()  # the pages of one file
            if onward is not None:
                numbers = (pages or []) + list(range(onward, len(found)))
            if offset is not None and not own:
                first = next((k for k, r in enumerate(found) if r["ifd_offset"] == offset), None)
                if first is None:
                    raise ValueError(f"no directory begins at {offset}")
                numbers = [first + k for k in (numbers if numbers is not None else range(len(found) - first)) if first + k < len(found)]
        made = sink.convert(one, options, numbers, None if own else change, ignore)
        made = made.select(F.lit(output or "copy.tif").alias("path"), F.lit(i).cast("long").alias("position"), F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("content")).alias("content"))
        parts = made if parts is None else parts.unionByName(made)
    whole = sink.assemble(parts, options, renumber) if len(given) > 1 or renumber else parts.select("path", "content")
    if output:
        folder = output.rsplit("/", 1)[0] if "/" in output else "."
        # a task writes the file; where the output is an input as well, its bytes are in that task already
        sink.save(whole, folder).collect()
        return load(spark, [output]).select("path", "content")
    return whole


def to_rgba(spark: SparkSession, inputs: list[str], folder: str | None = None, compression: str = "packbits", rows_per_strip: int = 0, no_alpha: bool = False) -> DataFrame:
    """Each file as an 8-bit RGBA (or RGB) TIFF: path, content and error, written to `folder` if there is one."""
    options = sink.WriteOptions.parse(compression)
    options.rows_per_strip = rows_per_strip
    made = sink.convert(load(spark, inputs).select("path", "content"), options, None, Changed(options, no_alpha, True))
    if folder:
        sink.save(made, folder).collect()
    return made


def to_pdf(spark: SparkSession, inputs: list[str], folder: str | None = None, options: pdf.PdfOptions | None = None) -> DataFrame:
    """Each file as a PDF: path, content and error, written to `folder` if there is one."""
    made = pdf.to_pdf(load(spark, inputs).select("path", "content"), options)
    if folder:
        sink.save(made, folder, ".pdf").collect()
    return made


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessella.tools", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("copy")
    c.add_argument("-a", dest="append", action="store_true")
    c.add_argument("-b", dest="bias")
    c.add_argument("-c", dest="compression", default="none")
    c.add_argument("-f", dest="fill", choices=("lsb2msb", "msb2lsb"), default="msb2lsb")
    c.add_argument("-l", dest="tile_length", type=int, default=0)
    c.add_argument("-w", dest="tile_width", type=int, default=0)
    c.add_argument("-t", dest="tiles", action="store_true")
    c.add_argument("-s", dest="strips", action="store_true")
    c.add_argument("-r", dest="rows", type=int, default=0)
    c.add_argument("-p", dest="planar", choices=("contig", "separate"))
    c.add_argument("-B", dest="order", action="store_const", const=">", default="<")
    c.add_argument("-L", dest="order", action="store_const", const="<")
    c.add_argument("-8", dest="big", action="store_true")
    c.add_argument("-i", dest="ignore", action="store_true", help="go on after chunks that can't be read")
    c.add_argument("-o", dest="offset", type=int, help="begin with the directory at this place")
    c.add_argument("-x", dest="renumber", action="store_true", help="number the pages anew")
    c.add_argument("-M", "-C", action="store_true", help="accepted; files aren't mapped, and raw strips aren't cut on output")
    c.add_argument("--separator", default=",")
    c.add_argument("files", nargs="+")
    r = commands.add_parser("rgba")
    r.add_argument("-c", dest="compression", default="packbits")
    r.add_argument("-r", dest="rows", type=int, default=0)
    r.add_argument("-n", dest="no_alpha", action="store_true")
    r.add_argument("-b", action="store_true", help="accepted; chunks are decoded one by one in any case")
    r.add_argument("files", nargs="+")
    p = commands.add_parser("pdf")
    for flag, name in (("-p", "paper"), ("-e", "created"), ("-c", "creator"), ("-a", "author"), ("-t", "title"), ("-s", "subject"), ("-k", "keywords")):
        p.add_argument(flag, dest=name)
    p.add_argument("-x", type=float)
    p.add_argument("-y", type=float)
    p.add_argument("-u", dest="unit", choices=("i", "m"), default="i")
    p.add_argument("-w", dest="width", type=float)
    p.add_argument("-l", dest="length", type=float)
    p.add_argument("-r", dest="resolution", choices=("d", "o"), default="d", help="-x and -y are for images without a resolution (d) or for all (o)")
    p.add_argument("-o", dest="output", help="the name of the one document")
    p.add_argument("-j", dest="jpeg", action="store_true")
    p.add_argument("-q", dest="quality", type=int, default=75)
    p.add_argument("-z", dest="zip", action="store_true")
    p.add_argument("-d", dest="plain", action="store_true")
    p.add_argument("-n", dest="decode", action="store_true")
    p.add_argument("-i", dest="invert", action="store_true")
    p.add_argument("-b", dest="interpolate", action="store_true")
    p.add_argument("-f", dest="fit", action="store_true")
    p.add_argument("files", nargs="+")
    commands.add_parser("info").add_argument("files", nargs="+")
    o = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("tessella").getOrCreate()
    if o.command == "info":
        for row in tiff.Tiff(load(spark, o.files)).report().orderBy("path", "ifd").toLocalIterator():
            print(f"{row['path']}, directory {row['ifd']}\n{row['report']}")
        return 0
    if o.command == "copy":
        options = sink.WriteOptions.parse(o.compression)
        options.fill_order, options.order, options.big, options.rows_per_strip, options.planar = 2 if o.fill == "lsb2msb" else 1, o.order, o.big, o.rows, 2 if o.planar == "separate" else 1
        # without any of these the source's strips, tiles and planes stay
        options.keep_layout = not (o.tiles or o.strips or o.rows or o.tile_width or o.tile_length or o.planar)
        if (o.tiles or o.tile_width or o.tile_length) and not o.strips:
            options.tile_width, options.tile_length = o.tile_width or sink.TILE, o.tile_length or sink.TILE
        copy(spark, o.files[:-1], o.files[-1], options, o.append, o.bias, o.separator, ignore=o.ignore, offset=o.offset, renumber=o.renumber)
        return 0
    if o.command == "rgba":
        made = to_rgba(spark, o.files[:-1], o.files[-1], o.compression, o.rows, o.no_alpha)
    else:
        x, y = o.x or o.y, o.y or o.x
        page = (o.width or o.length, o.length or o.width) if o.width or o.length else None
        wanted = pdf.PdfOptions(
            "jpeg" if o.jpeg else "zip" if o.zip else "none" if o.plain else "auto", not o.decode, (x, y) if x else None, "cm" if o.unit == "m" else "inch", o.paper, o.fit, o.resolution == "o", page, o.quality,
            o.invert, o.interpolate, o.title, o.author, o.subject, o.keywords, o.creator, o.created,
        )
        if o.output:
            made = to_pdf(spark, o.files, None, wanted)
            sink.save(made.withColumn("path", F.lit(o.output)), o.output.rsplit("/", 1)[0] if "/" in o.output else ".").collect()
        else:
            made = to_pdf(spark, o.files[:-1], o.files[-1], wanted)
    errors = made.where("error is not null").select("path", "error").collect()
    for row in errors:
        print(f"{row['path']}: {row['error']}")
    return int(bool(errors))


if __name__ == "__main__":
    raise SystemExit(main())
