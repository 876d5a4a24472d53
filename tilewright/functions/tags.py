"""Dimension tables: tags, value types, compressions, photometric interpretations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

# Codes of the TIFF 6.0 and BigTIFF formats and their common extensions.
TAGS = {
    "NewSubfileType": 254, "SubfileType": 255, "ImageWidth": 256, "ImageLength": 257, "BitsPerSample": 258, "Compression": 259,
    "PhotometricInterpretation": 262, "Thresholding": 263, "CellWidth": 264, "CellLength": 265, "FillOrder": 266, "DocumentName": 269,
    "ImageDescription": 270, "Make": 271, "Model": 272, "StripOffsets": 273, "Orientation": 274, "SamplesPerPixel": 277,
    "RowsPerStrip": 278, "StripByteCounts": 279, "MinSampleValue": 280, "MaxSampleValue": 281, "XResolution": 282, "YResolution": 283,
    "PlanarConfiguration": 284, "PageName": 285, "XPosition": 286, "YPosition": 287, "FreeOffsets": 288, "FreeByteCounts": 289,
    "GrayResponseUnit": 290, "GrayResponseCurve": 291, "T4Options": 292, "T6Options": 293, "ResolutionUnit": 296, "PageNumber": 297,
    "TransferFunction": 301, "Software": 305, "DateTime": 306, "Artist": 315, "HostComputer": 316, "Predictor": 317,
    "WhitePoint": 318, "PrimaryChromaticities": 319, "ColorMap": 320, "HalftoneHints": 321, "TileWidth": 322, "TileLength": 323,
    "TileOffsets": 324, "TileByteCounts": 325, "SubIFDs": 330, "InkSet": 332, "InkNames": 333, "NumberOfInks": 334,
    "DotRange": 336, "TargetPrinter": 337, "ExtraSamples": 338, "SampleFormat": 339, "SMinSampleValue": 340, "SMaxSampleValue": 341,
    "TransferRange": 342, "JPEGTables": 347, "JPEGProc": 512, "JPEGInterchangeFormat": 513, "JPEGInterchangeFormatLength": 514,
    "JPEGRestartInterval": 515, "JPEGLosslessPredictors": 517, "JPEGPointTransforms": 518, "JPEGQTables": 519, "JPEGDCTables": 520,
    "JPEGACTables": 521, "YCbCrCoefficients": 529, "YCbCrSubSampling": 530, "YCbCrPositioning": 531, "ReferenceBlackWhite": 532,
    "XMP": 700, "Copyright": 33432, "ExifIFD": 34665, "ICCProfile": 34675, "GPSIFD": 34853, "InteroperabilityIFD": 40965,
    "ExposureTime": 33434, "FNumber": 33437, "ExposureProgram": 34850, "SpectralSensitivity": 34852, "ISOSpeedRatings": 34855, "OECF": 34856,
    "ExifVersion": 36864, "DateTimeOriginal": 36867, "DateTimeDigitized": 36868, "ComponentsConfiguration": 37121, "CompressedBitsPerPixel": 37122, "ShutterSpeedValue": 37377,
    "ApertureValue": 37378, "BrightnessValue": 37379, "ExposureBiasValue": 37380, "MaxApertureValue": 37381, "SubjectDistance": 37382, "MeteringMode": 37383,
    "LightSource": 37384, "Flash": 37385, "FocalLength": 37386, "MakerNote": 37500, "UserComment": 37510, "SubSecTime": 37520,
    "SubSecTimeOriginal": 37521, "SubSecTimeDigitized": 37522, "FlashPixVersion": 40960, "ColorSpace": 40961, "PixelXDimension": 40962, "PixelYDimension": 40963,
    "RelatedSoundFile": 40964, "FlashEnergy": 41483, "SpatialFrequencyResponse": 41484, "FocalPlaneXResolution": 41486, "FocalPlaneYResolution": 41487, "FocalPlaneResolutionUnit": 41488,
    "SubjectLocation": 41492, "ExposureIndex": 41493, "SensingMethod": 41495, "FileSource": 41728, "SceneType": 41729, "CFAPattern": 41730,
    "CustomRendered": 41985, "ExposureMode": 41986, "WhiteBalance": 41987, "DigitalZoomRatio": 41988, "FocalLengthIn35mmFilm": 41989, "SceneCaptureType": 41990,
    "GainControl": 41991, "Contrast": 41992, "Saturation": 41993, "Sharpness": 41994, "SubjectDistanceRange": 41996, "Matteing": 32995,
    "DataType": 32996, "ImageDepth": 32997, "TileDepth": 32998, "StoNits": 37439,
}
TYPES = {"BYTE": (1, 1), "ASCII": (2, 1), "SHORT": (3, 2), "LONG": (4, 4), "RATIONAL": (5, 8), "SBYTE": (6, 1), "UNDEFINED": (7, 1), "SSHORT": (8, 2), "SLONG": (9, 4), "SRATIONAL": (10, 8), "FLOAT": (11, 4), "DOUBLE": (12, 8), "IFD": (13, 4), "LONG8": (16, 8), "SLONG8": (17, 8), "IFD8": (18, 8)}
#: Name: code, whether this engine reads it, whether it writes it.
COMPRESSIONS = {
    "NONE": (1, True, True), "CCITT_RLE": (2, True, True), "CCITT_T4": (3, True, True), "CCITT_T6": (4, True, True), "LZW": (5, True, True),
    "OLD_JPEG": (6, True, False), "JPEG": (7, True, True), "DEFLATE": (8, True, True), "NEXT": (32766, False, False), "PACK_BITS": (32773, True, True),
    "THUNDER_SCAN": (32809, True, False), "PIXAR_LOG": (32909, False, False), "OLD_DEFLATE": (32946, True, True), "JPEG_2000_APERIO": (33005, False, False), "JBIG": (34661, False, False),
    "SGI_LOG": (34676, True, False), "SGI_LOG_24": (34677, False, False), "JPEG_2000": (34712, False, False), "LOSSY_JPEG": (34892, True, False), "LZMA": (34925, True, True),
    "ZSTD": (50000, True, True), "WEBP": (50001, False, False),
    "JBIG_BW": (9, False, False), "JBIG_COLOR": (10, False, False), "JPEG_99": (99, False, False), "IMPACJ": (103, False, False), "KODAK_262": (262, False, False), "JPEGXR_NDPI": (22610, False, False),
    "SONY_ARW": (32767, False, False), "PACKED_RAW": (32769, False, False), "SAMSUNG_SRW": (32770, False, False), "CCITT_RLEW": (32771, False, False), "SAMSUNG_SRW2": (32772, False, False), "MBI_RLE": (32775, False, False),
    "IT8_CT_PAD": (32895, False, False), "IT8_LW": (32896, False, False), "IT8_MP": (32897, False, False), "IT8_BL": (32898, False, False), "PIXAR_FILM": (32908, False, False), "KODAK_DCS": (32947, False, False),
    "JPEG_2000_APERIO_33003": (33003, False, False), "JPEG_2000_APERIO_33004": (33004, False, False), "ALT_JPEG": (33007, False, False), "LURA_DOC": (34692, False, False), "NIKON_NEF": (34713, False, False), "JBIG2": (34715, False, False),
    "MDI_BINARY": (34718, False, False), "MDI_PROGRESSIVE": (34719, False, False), "MDI_VECTOR": (34720, False, False), "LERC": (34887, False, False), "ZSTD_DEPRECATED": (34926, False, False), "WEBP_DEPRECATED": (34927, False, False),
    "PNG": (34933, True, True), "JPEG_XR": (34934, False, False), "JETRAW": (48124, False, False), "JPEG_XL": (50002, False, False), "PIXTIFF": (50013, False, False), "JPEG_XL_DNG": (52546, False, False),
    "EER_V0": (65000, False, False), "EER_V1": (65001, False, False), "EER_V2": (65002, False, False),
}
PHOTOMETRIC = {"WHITE_IS_ZERO": 0, "BLACK_IS_ZERO": 1, "RGB": 2, "RGB_PALETTE": 3, "TRANSPARENCY_MASK": 4, "CMYK": 5, "Y_CB_CR": 6, "CIE_LAB": 8, "ICC_LAB": 9, "ITU_LAB": 10, "CFA_ARRAY": 32803, "LOG_L": 32844, "LOG_LUV": 32845}
PREDICTORS = {"NONE": 1, "HORIZONTAL": 2, "FLOATING_POINT": 3}


def tag_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted((c, n) for n, c in TAGS.items()), "code int, name string")


def type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, size) for n, (c, size) in TYPES.items()], "code int, name string, size int")


def compression_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, r, w) for n, (c, r, w) in COMPRESSIONS.items()], "code int, name string, readable boolean, writable boolean")


def photometric_table(spark: SparkSession) -> DataFrame:
    rows = [(c, n, n in ("WHITE_IS_ZERO", "CMYK"), n in ("RGB_PALETTE", "TRANSPARENCY_MASK")) for n, c in PHOTOMETRIC.items()]
    return spark.createDataFrame(rows, "code int, name string, inverted boolean, indexed boolean")


# What distinguishes compressions and photometric interpretations.
OLD_FORMATS = ("CCITT_RLE", "CCITT_T4", "CCITT_T6", "OLD_JPEG", "THUNDER_SCAN")
LOW_LEVEL = ("NONE", "CCITT_RLE", "CCITT_T4", "CCITT_T6", "LZW", "DEFLATE", "OLD_DEFLATE", "PACK_BITS", "THUNDER_SCAN", "LZMA", "ZSTD")
JPEG_2000 = ("JPEG_2000", "JPEG_2000_APERIO", "JPEG_2000_APERIO_33003", "JPEG_2000_APERIO_33004")
SIMPLY_RENDERABLE = ("WHITE_IS_ZERO", "BLACK_IS_ZERO", "RGB", "TRANSPARENCY_MASK", "Y_CB_CR", "LOG_L", "LOG_LUV")


def compression_predicates(code: Column) -> dict[str, Column]:
    """Predicates of a compression code: old_format, standard_jpeg, jpeg_or_old, jpeg_2000, jpeg_family, embedded_metadata, low_level, standard_or_low_level."""
    of = lambda names: code.isin(*(COMPRESSIONS[n][0] for n in names))
    low, standard, old = of(LOW_LEVEL), of(["JPEG"]), of(["OLD_JPEG"])
    return {
        "old_format": of(OLD_FORMATS), "standard_jpeg": standard, "jpeg_or_old": standard | old, "jpeg_2000": of(JPEG_2000), "jpeg_family": standard | old | of(JPEG_2000),
        "embedded_metadata": old, "low_level": low, "standard_or_low_level": (code <= 10) | low,
    }


def photometric_predicates(code: Column) -> dict[str, Column]:
    """Predicates of a photometric code: inverted, indexed, rescalable, renderable."""
    of = lambda names: code.isin(*(PHOTOMETRIC[n] for n in names))
    return {"inverted": of(["WHITE_IS_ZERO", "CMYK"]), "indexed": of(["RGB_PALETTE"]), "rescalable": ~of(["RGB_PALETTE", "TRANSPARENCY_MASK"]), "renderable": of(SIMPLY_RENDERABLE)}
