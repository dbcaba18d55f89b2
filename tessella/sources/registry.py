"""The tags that the reader knows: number, name, types and count of values, after the public TIFF and Exif specifications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Sizes of the types in bytes, and their names.
TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
TYPE_NAME = {1: "BYTE", 2: "ASCII", 3: "SHORT", 4: "LONG", 5: "RATIONAL", 6: "SBYTE", 7: "UNDEFINED", 8: "SSHORT", 9: "SLONG", 10: "SRATIONAL", 11: "FLOAT", 12: "DOUBLE", 13: "IFD", 16: "LONG8", 17: "SLONG8", 18: "IFD8"}
TYPE_NUMBER = {n: t for t, n in TYPE_NAME.items()}

# Baseline, extension and private tags. A count of -1 is variable, -2 is the number of samples.
IMAGE_TAGS = """
254 SubfileType LONG/SHORT 1
255 OldSubfileType SHORT 1
256 ImageWidth LONG/SHORT 1
257 ImageLength LONG/SHORT 1
258 BitsPerSample SHORT -2
259 Compression SHORT 1
262 PhotometricInterpretation SHORT 1
263 Threshholding SHORT 1
264 CellWidth SHORT 1
265 CellLength SHORT 1
266 FillOrder SHORT 1
269 DocumentName ASCII -1
270 ImageDescription ASCII -1
271 Make ASCII -1
272 Model ASCII -1
273 StripOffsets LONG8/LONG/SHORT -1
274 Orientation SHORT 1
277 SamplesPerPixel SHORT 1
278 RowsPerStrip LONG/SHORT 1
279 StripByteCounts LONG8/LONG/SHORT -1
280 MinSampleValue SHORT -2
281 MaxSampleValue SHORT -2
282 XResolution RATIONAL 1
283 YResolution RATIONAL 1
284 PlanarConfiguration SHORT 1
285 PageName ASCII -1
286 XPosition RATIONAL 1
287 YPosition RATIONAL 1
288 FreeOffsets LONG -1
289 FreeByteCounts LONG -1
290 GrayResponseUnit SHORT 1
291 GrayResponseCurve SHORT -1
292 Group3Options LONG 1
293 Group4Options LONG 1
296 ResolutionUnit SHORT 1
297 PageNumber SHORT 2
300 ColorResponseUnit SHORT 1
301 TransferFunction SHORT -1
305 Software ASCII -1
306 DateTime ASCII 20
315 Artist ASCII -1
316 HostComputer ASCII -1
317 Predictor SHORT 1
318 WhitePoint RATIONAL 2
319 PrimaryChromaticities RATIONAL 6
320 ColorMap SHORT -1
321 HalftoneHints SHORT 2
322 TileWidth LONG/SHORT 1
323 TileLength LONG/SHORT 1
324 TileOffsets LONG8/LONG -1
325 TileByteCounts LONG8/LONG/SHORT -1
326 BadFaxLines LONG/SHORT 1
327 CleanFaxData SHORT 1
328 ConsecutiveBadFaxLines LONG/SHORT 1
330 SubIFD IFD/IFD8/LONG -1
332 InkSet SHORT 1
333 InkNames ASCII -1
334 NumberOfInks SHORT 1
336 DotRange SHORT/BYTE 2
337 TargetPrinter ASCII -1
338 ExtraSamples SHORT/BYTE -1
339 SampleFormat SHORT -2
340 SMinSampleValue DOUBLE/FLOAT/LONG/SHORT/BYTE -2
341 SMaxSampleValue DOUBLE/FLOAT/LONG/SHORT/BYTE -2
343 ClipPath BYTE -1
344 XClipPathUnits LONG 1
345 YClipPathUnits LONG 1
347 JPEGTables UNDEFINED -1
512 JPEGProc SHORT 1
513 JPEGInterchangeFormat LONG 1
514 JPEGInterchangeFormatLength LONG 1
515 JPEGRestartInterval SHORT 1
519 JPEGQTables LONG -1
520 JPEGDCTables LONG -1
521 JPEGACTables LONG -1
529 YCbCrCoefficients RATIONAL 3
530 YCbCrSubsampling SHORT 2
531 YCbCrPositioning SHORT 1
532 ReferenceBlackWhite RATIONAL/LONG 6
700 XMLPacket BYTE -1
32995 Matteing SHORT 1
32996 DataType SHORT -2
32997 ImageDepth LONG/SHORT 1
32998 TileDepth LONG/SHORT 1
33300 ImageFullWidth LONG 1
33301 ImageFullLength LONG 1
33302 TextureFormat ASCII -1
33303 TextureWrapModes ASCII -1
33304 FieldOfViewCotangent FLOAT 1
33305 MatrixWorldToScreen FLOAT 16
33306 MatrixWorldToCamera FLOAT 16
33432 Copyright ASCII -1
33723 RichTIFFIPTC LONG -1
34377 Photoshop BYTE -1
34665 EXIFIFDOffset LONG 1
34675 ICCProfile UNDEFINED -1
34853 GPSIFDOffset LONG 1
34908 FaxRecvParams LONG 1
34909 FaxSubAddress ASCII -1
34910 FaxRecvTime LONG 1
34911 FaxDcs ASCII -1
37439 StoNits DOUBLE 1
40965 InteroperabilityIFDOffset LONG 1
"""
# DNG tags.
DNG_TAGS = """
50706 DNGVersion BYTE 4
50707 DNGBackwardVersion BYTE 4
50708 UniqueCameraModel ASCII -1
50709 LocalizedCameraModel BYTE/ASCII -1
50710 CFAPlaneColor BYTE -1
50711 CFALayout SHORT 1
50712 LinearizationTable SHORT -1
50713 BlackLevelRepeatDim SHORT 2
50714 BlackLevel RATIONAL/LONG/SHORT -1
50715 BlackLevelDeltaH SRATIONAL -1
50716 BlackLevelDeltaV SRATIONAL -1
50717 WhiteLevel LONG/SHORT -2
50718 DefaultScale RATIONAL 2
50719 DefaultCropOrigin RATIONAL/LONG/SHORT 2
50720 DefaultCropSize RATIONAL/LONG/SHORT 2
50721 ColorMatrix1 SRATIONAL -1
50722 ColorMatrix2 SRATIONAL -1
50723 CameraCalibration1 SRATIONAL -1
50724 CameraCalibration2 SRATIONAL -1
50725 ReductionMatrix1 SRATIONAL -1
50726 ReductionMatrix2 SRATIONAL -1
50727 AnalogBalance RATIONAL -1
50728 AsShotNeutral RATIONAL -1
50729 AsShotWhiteXY RATIONAL 2
50730 BaselineExposure SRATIONAL 1
50731 BaselineNoise RATIONAL 1
50732 BaselineSharpness RATIONAL 1
50733 BayerGreenSplit LONG 1
50734 LinearResponseLimit RATIONAL 1
50735 CameraSerialNumber ASCII -1
50736 LensInfo RATIONAL 4
50737 ChromaBlurRadius RATIONAL 1
50738 AntiAliasStrength RATIONAL 1
50739 ShadowScale RATIONAL 1
50740 DNGPrivateData BYTE -1
50741 MakerNoteSafety SHORT 1
50778 CalibrationIlluminant1 SHORT 1
50779 CalibrationIlluminant2 SHORT 1
50780 BestQualityScale RATIONAL 1
50781 RawDataUniqueID BYTE 16
50827 OriginalRawFileName BYTE/ASCII -1
50828 OriginalRawFileData UNDEFINED -1
50829 ActiveArea LONG/SHORT 4
50830 MaskedAreas LONG/SHORT -1
50831 AsShotICCProfile UNDEFINED -1
50832 AsShotPreProfileMatrix SRATIONAL -1
50833 CurrentICCProfile UNDEFINED -1
50834 CurrentPreProfileMatrix SRATIONAL -1
"""
# Exif tags.
EXIF_TAGS = """
33434 ExposureTime RATIONAL 1
33437 FNumber RATIONAL 1
34850 ExposureProgram SHORT 1
34852 SpectralSensitivity ASCII -1
34855 ISOSpeedRatings SHORT -1
34856 OptoelectricConversionFactor UNDEFINED -1
36864 ExifVersion UNDEFINED 4
36867 DateTimeOriginal ASCII 20
36868 DateTimeDigitized ASCII 20
37121 ComponentsConfiguration UNDEFINED 4
37122 CompressedBitsPerPixel RATIONAL 1
37377 ShutterSpeedValue SRATIONAL 1
37378 ApertureValue RATIONAL 1
37379 BrightnessValue SRATIONAL 1
37380 ExposureBiasValue SRATIONAL 1
37381 MaxApertureValue RATIONAL 1
37382 SubjectDistance RATIONAL 1
37383 MeteringMode SHORT 1
37384 LightSource SHORT 1
37385 Flash SHORT 1
37386 FocalLength RATIONAL 1
37396 SubjectArea SHORT -1
37500 MakerNote UNDEFINED -1
37510 UserComment UNDEFINED -1
37520 SubSecTime ASCII -1
37521 SubSecTimeOriginal ASCII -1
37522 SubSecTimeDigitized ASCII -1
40960 FlashpixVersion UNDEFINED 4
40961 ColorSpace SHORT 1
40962 PixelXDimension LONG/SHORT 1
40963 PixelYDimension LONG/SHORT 1
40964 RelatedSoundFile ASCII 13
41483 FlashEnergy RATIONAL 1
41484 SpatialFrequencyResponse UNDEFINED -1
41486 FocalPlaneXResolution RATIONAL 1
41487 FocalPlaneYResolution RATIONAL 1
41488 FocalPlaneResolutionUnit SHORT 1
41492 SubjectLocation SHORT 2
41493 ExposureIndex RATIONAL 1
41495 SensingMethod SHORT 1
41728 FileSource UNDEFINED 1
41729 SceneType UNDEFINED 1
41730 CFAPattern UNDEFINED -1
41985 CustomRendered SHORT 1
41986 ExposureMode SHORT 1
41987 WhiteBalance SHORT 1
41988 DigitalZoomRatio RATIONAL 1
41989 FocalLengthIn35mmFilm SHORT 1
41990 SceneCaptureType SHORT 1
41991 GainControl RATIONAL 1
41992 Contrast SHORT 1
41993 Saturation SHORT 1
41994 Sharpness SHORT 1
41995 DeviceSettingDescription UNDEFINED -1
41996 SubjectDistanceRange SHORT 1
42016 ImageUniqueID ASCII 33
"""


def _parsed(text: str, kind: str) -> list[tuple[int, str, int, int, str]]:
    out = []
    for line in text.strip().splitlines():
        tag, name, types, count = line.split()
        out += [(int(tag), name, TYPE_NUMBER[t], int(count), kind) for t in types.split("/")]
    return out


ROWS = _parsed(IMAGE_TAGS, "image") + _parsed(DNG_TAGS, "image") + _parsed(EXIF_TAGS, "exif")
NAMES = {(kind, tag): name for tag, name, _, _, kind in ROWS}
BY_NAME = {name: tag for tag, name, _, _, _ in ROWS}
FIRST_TYPE = {}
for _tag, _, _type, _, _kind in ROWS:
    FIRST_TYPE.setdefault((_kind, _tag), _type)
#: Tags of the directory itself, which a directory's columns hold; all others are custom.
STRUCTURAL = {254, 256, 257, 258, 259, 262, 266, 273, 274, 277, 278, 279, 282, 283, 284, 296, 297, 317, 320, 322, 323, 324, 325, 330, 338, 339, 530, 32997, 32998}

_EXTRA: dict[int, tuple[str, int, int]] = {}


def register_tags(tags: list[tuple[int, str, str, int]]) -> None:
    """Adds (number, name, type, count) to what the reader knows; a number that it knows stays as it is."""
    for tag, name, kind, count in tags:
        if ("image", tag) not in NAMES:
            _EXTRA[tag] = (name, TYPE_NUMBER[kind.upper()], count)


def extra_names() -> dict[int, str]:
    return {t: n for t, (n, _, _) in _EXTRA.items()}


def tag_name(tag: int, kind: str = "image", extra: dict[int, str] | None = None) -> str:
    name = NAMES.get((kind, tag)) or (kind != "image" and NAMES.get(("image", tag)))
    return name or (extra and extra.get(tag)) or f"Tag {tag}"


def registry(spark: SparkSession) -> DataFrame:
    """tag, name, type, count and kind of all known fields."""
    more = [(t, n, k, c, "image") for t, (n, k, c) in _EXTRA.items()]
    return spark.createDataFrame(ROWS + more, "tag int, name string, type int, count int, kind string")


#: Defaults of tags that a directory doesn't have.
DEFAULTS = {254: 0, 258: 1, 259: 1, 263: 1, 266: 1, 274: 1, 277: 1, 278: 0xFFFFFFFF, 280: 0, 284: 1, 296: 2, 317: 1, 332: 1, 334: 4, 339: 1, 531: 1, 32997: 1, 32998: 1}

# Fixed values of the format: names of numbers that tags with a choice may have.
VALUE_NAMES = {
    254: {0: "image", 1: "reduced image", 2: "page", 4: "mask"},
    259: {1: "none", 2: "CCITT RLE", 3: "CCITT G3", 4: "CCITT G4", 5: "LZW", 6: "old JPEG", 7: "JPEG", 8: "Deflate", 32771: "CCITT RLEW", 32773: "PackBits", 32946: "old Deflate"},
    262: {0: "white is zero", 1: "black is zero", 2: "RGB", 3: "palette", 4: "mask", 5: "separated", 6: "YCbCr", 8: "CIE L*a*b*"},
    266: {1: "high bit first", 2: "low bit first"},
    274: {1: "top left", 2: "top right", 3: "bottom right", 4: "bottom left", 5: "left top", 6: "right top", 7: "right bottom", 8: "left bottom"},
    284: {1: "contiguous", 2: "separate planes"},
    296: {1: "none", 2: "inch", 3: "centimetre"},
    317: {1: "none", 2: "horizontal differences", 3: "floating point"},
    332: {1: "CMYK", 2: "other inks"},
    339: {1: "unsigned", 2: "signed", 3: "floating point", 4: "undefined", 5: "complex whole numbers", 6: "complex floating point"},
    531: {1: "centred", 2: "cosited"},
}
