"""Constant dimensions: small tables whose row counts are known here, so they may be broadcast."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values (public standards; results depend on them) -----------------------------------

# ITU-T T.81 Annex K quantisation tables, row order.
STD_QUANT_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
STD_QUANT_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)

# Encoders known to use the common public JPEG library, matched inside the software tag.
IJG_SOFTWARE = (
    "GIMP", "IrfanView", "idImager", "FastStone Image Viewer", "NeatImage", "Paint.NET", "Photomatix", "XnView",
)
# Software markers looked for inside a comment.
COMMENT_SOFTWARE = ("gd-jpeg", "Photoshop", "ACD Systems", "AppleMark", "PICResize", "NeatImage")

# IPTC-NAA Information Interchange Model 4: record, dataset, value type, name.
IPTC_FIELDS = (
    (1, 0, "NUM", "Model Version"),
    (1, 5, "STR", "Destination"),
    (1, 20, "NUM", "File Format"),
    (1, 22, "NUM", "File Format Version"),
    (1, 30, "STR", "Service Identifier"),
    (1, 40, "STR", "Envelope Number"),
    (1, 50, "STR", "Product I.D."),
    (1, 60, "STR", "Envelope Priority"),
    (1, 70, "STR", "Date Sent"),
    (1, 80, "STR", "Time Sent"),
    (1, 90, "STR", "Coded Character Set"),
    (1, 100, "STR", "UNO"),
    (1, 120, "NUM", "ARM Identifier"),
    (1, 122, "NUM", "ARM Version"),
    (2, 0, "NUM", "Record Version"),
    (2, 3, "STR", "Object Type Reference"),
    (2, 4, "STR", "Object Attrib Reference"),
    (2, 5, "STR", "Object Name"),
    (2, 7, "STR", "Edit Status"),
    (2, 8, "STR", "Editorial Update"),
    (2, 10, "STR", "Urgency"),
    (2, 12, "STR", "Subject Reference"),
    (2, 15, "STR", "Category"),
    (2, 20, "STR", "Supplemental Category"),
    (2, 22, "STR", "Fixture Identifier"),
    (2, 25, "STR", "Keywords"),
    (2, 26, "STR", "Content Location Code"),
    (2, 27, "STR", "Content Location Name"),
    (2, 30, "STR", "Release Date"),
    (2, 35, "STR", "Release Time"),
    (2, 37, "STR", "Expiration Date"),
    (2, 38, "STR", "Expiration Time"),
    (2, 40, "STR", "Special Instructions"),
    (2, 42, "STR", "Action Advised"),
    (2, 45, "UNK", "Reference Service"),
    (2, 47, "UNK", "Reference Date"),
    (2, 50, "UNK", "Reference Number"),
    (2, 55, "STR", "Date Created"),
    (2, 60, "STR", "Time Created"),
    (2, 62, "STR", "Digital Creation Date"),
    (2, 63, "STR", "Digital Creation Time"),
    (2, 65, "STR", "Originating Program"),
    (2, 70, "STR", "Program Version"),
    (2, 75, "STR", "Object Cycle"),
    (2, 80, "STR", "By-line"),
    (2, 85, "STR", "By-line Title"),
    (2, 90, "STR", "City"),
    (2, 92, "STR", "Sub-location"),
    (2, 95, "STR", "Province/State"),
    (2, 100, "STR", "Country/Primary Location Code"),
    (2, 101, "STR", "Country/Primary Location Name"),
    (2, 103, "STR", "Original Transmission Reference"),
    (2, 105, "STR", "Headline"),
    (2, 110, "STR", "Credit"),
    (2, 115, "STR", "Source"),
    (2, 116, "STR", "Copyright Notice"),
    (2, 118, "STR", "Contact"),
    (2, 120, "STR", "Caption/Abstract"),
    (2, 122, "STR", "Writer/Editor"),
    (2, 125, "UNK", "Rasterized Caption"),
    (2, 130, "STR", "Image Type"),
    (2, 131, "STR", "Image Orientation"),
    (2, 135, "STR", "Language Identifier"),
    (2, 150, "STR", "Audio Type"),
    (2, 151, "STR", "Audio Sampling Rate"),
    (2, 152, "STR", "Audio Sampling Resolution"),
    (2, 153, "STR", "Audio Duration"),
    (2, 154, "STR", "Audio Outcue"),
    (2, 200, "NUM", "ObjectData Preview File Format"),
    (2, 201, "NUM", "ObjectData Preview File Format Version"),
    (2, 202, "UNK", "ObjectData Preview Data"),
    (7, 10, "NUM", "Size Mode"),
    (7, 20, "NUM", "Max Subfile Size"),
    (7, 90, "NUM", "ObjectData Size Announced"),
    (7, 95, "NUM", "Maximum ObjectData Size"),
    (8, 10, "UNK", "Subfile"),
    (9, 10, "NUM", "Confirmed ObjectData Size"),
)

# Image resource blocks: first id, last id (0 = single id), name.
RESOURCE_IDS = (
    (0x03E8, 0, "-"),
    (0x03E9, 0, "Macintosh print manager print info record"),
    (0x03EB, 0, "Indexed color table"),
    (0x03ED, 0, "ResolutionInfo structure"),
    (0x03EE, 0, "Names of alpha channels"),
    (0x03EF, 0, "DisplayInfo structure"),
    (0x03F0, 0, "Caption"),
    (0x03F1, 0, "Border information"),
    (0x03F2, 0, "Background color"),
    (0x03F3, 0, "Print flags"),
    (0x03F4, 0, "Grayscale and multichannel halftoning information"),
    (0x03F5, 0, "Color halftoning information"),
    (0x03F6, 0, "Duotone halftoning information"),
    (0x03F7, 0, "Grayscale and multichannel transfer function"),
    (0x03F8, 0, "Color transfer functions"),
    (0x03F9, 0, "Duotone transfer functions"),
    (0x03FA, 0, "Duotone image information"),
    (0x03FC, 0, "-"),
    (0x03FD, 0, "EPS options"),
    (0x03FE, 0, "Quick Mask information"),
    (0x03FF, 0, "-"),
    (0x0400, 0, "Layer state information"),
    (0x0401, 0, "Working path"),
    (0x0402, 0, "Layers group information"),
    (0x0403, 0, "-"),
    (0x0404, 0, "IPTC-NAA record"),
    (0x0405, 0, "Image mode (raw format files)"),
    (0x0406, 0, "JPEG quality"),
    (0x0408, 0, "Grid and guides information"),
    (0x0409, 0, "Thumbnail resource (PS 4.0)"),
    (0x040A, 0, "Copyright flag"),
    (0x040B, 0, "URL"),
    (0x040C, 0, "Thumbnail resources"),
    (0x040D, 0, "Global Angle"),
    (0x040E, 0, "Color samplers resource"),
    (0x040F, 0, "ICC Profile"),
    (0x0410, 0, "Watermark"),
    (0x0411, 0, "ICC Untagged Profile"),
    (0x0412, 0, "Effects visible"),
    (0x0413, 0, "Spot Halftone"),
    (0x0414, 0, "Document-specific IDs seed number"),
    (0x0415, 0, "Unicode Alpha Names"),
    (0x0416, 0, "Indexed Color Table Count"),
    (0x0417, 0, "Transparency Index"),
    (0x0419, 0, "Global Altitude"),
    (0x041A, 0, "Slices"),
    (0x041B, 0, "Workflow URL"),
    (0x041C, 0, "Jump to XPEP"),
    (0x041D, 0, "Alpha Identifiers"),
    (0x041E, 0, "URL List"),
    (0x0421, 0, "Version Info"),
    (0x0422, 0, "Exif data 1"),
    (0x0423, 0, "Exif data 3"),
    (0x0424, 0, "XMP metadata"),
    (0x0425, 0, "Caption digest"),
    (0x0426, 0, "Print scale"),
    (0x0428, 0, "Pixel Aspect Ratio"),
    (0x0429, 0, "Layer Comps"),
    (0x042A, 0, "Alternate Duotone Colors"),
    (0x042B, 0, "Alternate Spot Colors"),
    (0x042D, 0, "Layer Selection IDs"),
    (0x042E, 0, "HDR Toning information"),
    (0x042F, 0, "Print info"),
    (0x0430, 0, "Layer Groups Enabled ID"),
    (0x0431, 0, "Color samplers resource"),
    (0x0432, 0, "Measurement Scale"),
    (0x0433, 0, "Timeline Information"),
    (0x0434, 0, "Sheet Disclosure"),
    (0x0435, 0, "DisplayInfo structure (FloatPt colors)"),
    (0x0436, 0, "Onion Skins"),
    (0x0438, 0, "Count Information"),
    (0x043A, 0, "Print Information"),
    (0x043B, 0, "Print Style"),
    (0x043C, 0, "Macintosh NSPrintInfo"),
    (0x043D, 0, "Windows DEVMODE"),
    (0x043E, 0, "Auto Save File Path"),
    (0x043F, 0, "Auto Save Format"),
    (0x0440, 0, "Path Selection State"),
    (0x07D0, 0x0BB6, "Path Information (saved paths)"),
    (0x0BB7, 0, "Name of clipping path"),
    (0x0BB8, 0, "Origin Path Info"),
    (0x0FA0, 0x1387, "Plug-In resources"),
    (0x1B58, 0, "Image Ready variables"),
    (0x1B59, 0, "Image Ready data sets"),
    (0x1F40, 0, "Lightroom workflow"),
    (0x2710, 0, "Print flags information"),
)

# Document enumerations: field, value (number, or the four-character blend key), text.
PSD_ENUMS = (
    ("color_mode", 0, "Bitmap"),
    ("color_mode", 1, "Grayscale"),
    ("color_mode", 2, "Indexed"),
    ("color_mode", 3, "RGB"),
    ("color_mode", 4, "CMYK"),
    ("color_mode", 7, "Multichannel"),
    ("color_mode", 8, "Duotone"),
    ("color_mode", 9, "Lab"),
    ("resolution_unit", 1, "pixels per inch"),
    ("resolution_unit", 2, "pixels per cm"),
    ("width_unit", 1, "inch"),
    ("width_unit", 2, "cm"),
    ("width_unit", 3, "picas"),
    ("width_unit", 4, "columns"),
    ("print_scale_style", 0, "centered"),
    ("print_scale_style", 1, "size to fit"),
    ("print_scale_style", 2, "user defined"),
    ("guide_direction", 0, "vertical"),
    ("guide_direction", 1, "horizontal"),
    ("blend_mode", "pass", "pass through"),
    ("blend_mode", "norm", "normal"),
    ("blend_mode", "diss", "dissolve"),
    ("blend_mode", "dark", "darken"),
    ("blend_mode", "mul ", "multiply"),
    ("blend_mode", "idiv", "color burn"),
    ("blend_mode", "lbrn", "linear burn"),
    ("blend_mode", "dkCl", "darker color"),
    ("blend_mode", "lite", "lighten"),
    ("blend_mode", "scrn", "screen"),
    ("blend_mode", "div ", "color dodge"),
    ("blend_mode", "lddg", "linear dodge"),
    ("blend_mode", "lgCl", "lighter color"),
    ("blend_mode", "over", "overlay"),
    ("blend_mode", "sLit", "soft light"),
    ("blend_mode", "hLit", "hard light"),
    ("blend_mode", "vLit", "vivid light"),
    ("blend_mode", "lLit", "linear light"),
    ("blend_mode", "pLit", "pin light"),
    ("blend_mode", "hMix", "hard mix"),
    ("blend_mode", "diff", "difference"),
    ("blend_mode", "smud", "exclusion"),
    ("blend_mode", "fsub", "subtract"),
    ("blend_mode", "fdiv", "divide"),
    ("blend_mode", "hue ", "hue"),
    ("blend_mode", "sat ", "saturation"),
    ("blend_mode", "colr", "color"),
    ("blend_mode", "lum ", "luminosity"),
)

# Resource payloads: id, then its fields as name, kind[:enumeration], offset, width in bytes.
RESOURCE_FIELDS = (
    (0x03ED, "h_resolution", "fixed", 0, 4),
    (0x03ED, "h_unit", "enum:resolution_unit", 4, 2),
    (0x03ED, "width_unit", "enum:width_unit", 6, 2),
    (0x03ED, "v_resolution", "fixed", 8, 4),
    (0x03ED, "v_unit", "enum:resolution_unit", 12, 2),
    (0x03ED, "height_unit", "enum:width_unit", 14, 2),
    (0x03F3, "labels", "bool", 0, 1),
    (0x03F3, "crop_marks", "bool", 1, 1),
    (0x03F3, "color_bars", "bool", 2, 1),
    (0x03F3, "registration_marks", "bool", 3, 1),
    (0x03F3, "negative", "bool", 4, 1),
    (0x03F3, "flip", "bool", 5, 1),
    (0x03F3, "interpolate", "bool", 6, 1),
    (0x03F3, "caption", "bool", 7, 1),
    (0x03F3, "print_flags", "bool", 8, 1),
    (0x0400, "target_layer", "num", 0, 2),
    (0x0406, "quality", "quality", 0, 2),
    (0x0406, "format", "format", 2, 2),
    (0x0406, "scans", "scans", 4, 2),
    (0x0408, "version", "num", 0, 4),
    (0x0408, "grid_horizontal", "num", 4, 4),
    (0x0408, "grid_vertical", "num", 8, 4),
    (0x0408, "guides", "num", 12, 4),
    (0x040A, "copyright", "bool", 0, 1),
    (0x040C, "format", "num", 0, 4),
    (0x040C, "width", "num", 4, 4),
    (0x040C, "height", "num", 8, 4),
    (0x040C, "width_bytes", "num", 12, 4),
    (0x040C, "total_size", "num", 16, 4),
    (0x040C, "compressed_size", "num", 20, 4),
    (0x040C, "bits_per_pixel", "num", 24, 2),
    (0x040C, "planes", "num", 26, 2),
    (0x040C, "jfif_offset", "place", 28, 0),
    (0x040D, "angle", "num", 0, 4),
    (0x0414, "seed", "num", 0, 4),
    (0x0415, "text", "wide", 0, 0),
    (0x0419, "altitude", "num", 0, 4),
    (0x041B, "text", "wide", 0, 0),
    (0x0421, "version", "num", 0, 4),
    (0x0421, "has_merged_data", "num", 4, 1),
    (0x0421, "writer", "wide", 5, 0),
    (0x0424, "xmp", "utf8", 0, 0),
    (0x0426, "style", "enum:print_scale_style", 0, 2),
    (0x0426, "x", "single", 2, 4),
    (0x0426, "y", "single", 6, 4),
    (0x0426, "scale", "single", 10, 4),
    (0x0428, "version", "num", 0, 4),
    (0x0428, "ratio", "double", 4, 4),
    (0x042D, "selected", "num", 0, 2),
    (0x2710, "version", "num", 0, 2),
    (0x2710, "center_crop_marks", "num", 2, 1),
    (0x2710, "reserved", "num", 3, 1),
    (0x2710, "bleed_width", "num", 4, 4),
    (0x2710, "bleed_scale", "num", 8, 2),
)
# Fields behind one or two length-prefixed wide texts: the same, with the texts to skip.
RESOURCE_FIELDS_BEHIND_TEXT = (
    (0x0421, "reader", "wide", 5, 0, 1),
    (0x0421, "file_version", "num", 5, 4, 2),
)
# List items: the same, with item size, fields per item, list start, and offset and width of its length (or None).
RESOURCE_LISTS = (
    (0x0402, "layer_group", "num", 0, 2, 2, 1, 0, None, None),
    (0x0408, "location", "num", 16, 4, 5, 2, 16, 12, 4),
    (0x0408, "direction", "enum:guide_direction", 20, 1, 5, 2, 16, 12, 4),
    (0x042D, "layer_id", "num", 2, 4, 4, 1, 2, 0, 2),
    (0x0430, "layer_enabled", "num", 0, 1, 1, 1, 0, None, None),
)

# TIFF 6 / EXIF 2.3 tags by section: id, name.
EXIF_TAGS = (
    ("ifd0", 0x010E, "ImageDescription"),
    ("ifd0", 0x010F, "Make"),
    ("ifd0", 0x0110, "Model"),
    ("ifd0", 0x0112, "Orientation"),
    ("ifd0", 0x011A, "XResolution"),
    ("ifd0", 0x011B, "YResolution"),
    ("ifd0", 0x0128, "ResolutionUnit"),
    ("ifd0", 0x0131, "Software"),
    ("ifd0", 0x0132, "DateTime"),
    ("ifd0", 0x013B, "Artist"),
    ("ifd0", 0x013E, "WhitePoint"),
    ("ifd0", 0x013F, "PrimaryChromaticities"),
    ("ifd0", 0x0211, "YCbCrCoefficients"),
    ("ifd0", 0x0213, "YCbCrPositioning"),
    ("ifd0", 0x0214, "ReferenceBlackWhite"),
    ("ifd0", 0x8298, "Copyright"),
    ("ifd0", 0x8769, "ExifOffset"),
    ("ifd0", 0x8825, "GPSOffset"),
    ("ifd1", 0x0103, "Compression"),
    ("ifd1", 0x0201, "JpegIFOffset"),
    ("ifd1", 0x0202, "JpegIFByteCount"),
    ("exif", 0x829A, "ExposureTime"),
    ("exif", 0x829D, "FNumber"),
    ("exif", 0x8822, "ExposureProgram"),
    ("exif", 0x8827, "ISOSpeedRatings"),
    ("exif", 0x9000, "ExifVersion"),
    ("exif", 0x9003, "DateTimeOriginal"),
    ("exif", 0x9004, "DateTimeDigitized"),
    ("exif", 0x9101, "ComponentsConfiguration"),
    ("exif", 0x9102, "CompressedBitsPerPixel"),
    ("exif", 0x9201, "ShutterSpeedValue"),
    ("exif", 0x9202, "ApertureValue"),
    ("exif", 0x9203, "BrightnessValue"),
    ("exif", 0x9204, "ExposureBiasValue"),
    ("exif", 0x9205, "MaxApertureValue"),
    ("exif", 0x9206, "SubjectDistance"),
    ("exif", 0x9207, "MeteringMode"),
    ("exif", 0x9208, "LightSource"),
    ("exif", 0x9209, "Flash"),
    ("exif", 0x920A, "FocalLength"),
    ("exif", 0x927C, "MakerNote"),
    ("exif", 0x9286, "UserComment"),
    ("exif", 0xA000, "FlashPixVersion"),
    ("exif", 0xA001, "ColorSpace"),
    ("exif", 0xA002, "ExifImageWidth"),
    ("exif", 0xA003, "ExifImageHeight"),
    ("exif", 0xA005, "InteroperabilityOffset"),
    ("exif", 0xA20E, "FocalPlaneXResolution"),
    ("exif", 0xA20F, "FocalPlaneYResolution"),
    ("exif", 0xA210, "FocalPlaneResolutionUnit"),
    ("exif", 0xA217, "SensingMethod"),
    ("exif", 0xA300, "FileSource"),
    ("exif", 0xA301, "SceneType"),
    ("exif", 0xA401, "CustomRendered"),
    ("exif", 0xA402, "ExposureMode"),
    ("exif", 0xA403, "WhiteBalance"),
    ("exif", 0xA404, "DigitalZoomRatio"),
    ("exif", 0xA405, "FocalLengthIn35mmFilm"),
    ("exif", 0xA406, "SceneCaptureType"),
    ("interop", 0x0001, "InteroperabilityIndex"),
    ("interop", 0x0002, "InteroperabilityVersion"),
    ("gps", 0x00, "GPSVersionID"),
    ("gps", 0x01, "GPSLatitudeRef"),
    ("gps", 0x02, "GPSLatitude"),
    ("gps", 0x03, "GPSLongitudeRef"),
    ("gps", 0x04, "GPSLongitude"),
    ("gps", 0x05, "GPSAltitudeRef"),
    ("gps", 0x06, "GPSAltitude"),
    ("gps", 0x07, "GPSTimeStamp"),
    ("gps", 0x08, "GPSSatellites"),
    ("gps", 0x09, "GPSStatus"),
    ("gps", 0x0A, "GPSMeasureMode"),
    ("gps", 0x0B, "GPSDOP"),
    ("gps", 0x0C, "GPSSpeedRef"),
    ("gps", 0x0D, "GPSSpeed"),
    ("gps", 0x0E, "GPSTrackRef"),
    ("gps", 0x0F, "GPSTrack"),
    ("gps", 0x10, "GPSImgDirectionRef"),
    ("gps", 0x11, "GPSImgDirection"),
    ("gps", 0x12, "GPSMapDatum"),
    ("gps", 0x13, "GPSDestLatitudeRef"),
    ("gps", 0x14, "GPSDestLatitude"),
    ("gps", 0x15, "GPSDestLongitudeRef"),
    ("gps", 0x16, "GPSDestLongitude"),
    ("gps", 0x17, "GPSDestBearingRef"),
    ("gps", 0x18, "GPSDestBearing"),
    ("gps", 0x19, "GPSDestDistanceRef"),
    ("gps", 0x1A, "GPSDestDistance"),
    ("gps", 0x1B, "GPSProcessingMethod"),
    ("gps", 0x1C, "GPSAreaInformation"),
    ("gps", 0x1D, "GPSDateStamp"),
    ("gps", 0x1E, "GPSDifferential"),
)

# Fixed values of DICOM PS3.6: meta, general, patient, acquisition, relationship and image elements. A whole registry can be handed in.
DICOM_CORE_TAGS = (
    (0x0002, 0x0001, "File Meta Information Version"),
    (0x0002, 0x0002, "Media Storage SOP Class UID"),
    (0x0002, 0x0003, "Media Storage SOP Instance UID"),
    (0x0002, 0x0010, "Transfer Syntax UID"),
    (0x0002, 0x0012, "Implementation Class UID"),
    (0x0002, 0x0013, "Implementation Version Name"),
    (0x0002, 0x0016, "Source Application Entity Title"),
    (0x0008, 0x0005, "Specific Character Set"),
    (0x0008, 0x0008, "Image Type"),
    (0x0008, 0x0012, "Instance Creation Date"),
    (0x0008, 0x0013, "Instance Creation Time"),
    (0x0008, 0x0016, "SOP Class UID"),
    (0x0008, 0x0018, "SOP Instance UID"),
    (0x0008, 0x0020, "Study Date"),
    (0x0008, 0x0021, "Series Date"),
    (0x0008, 0x0022, "Acquisition Date"),
    (0x0008, 0x0023, "Content Date"),
    (0x0008, 0x0030, "Study Time"),
    (0x0008, 0x0031, "Series Time"),
    (0x0008, 0x0032, "Acquisition Time"),
    (0x0008, 0x0033, "Content Time"),
    (0x0008, 0x0050, "Accession Number"),
    (0x0008, 0x0060, "Modality"),
    (0x0008, 0x0064, "Conversion Type"),
    (0x0008, 0x0070, "Manufacturer"),
    (0x0008, 0x0080, "Institution Name"),
    (0x0008, 0x0090, "Referring Physician's Name"),
    (0x0008, 0x1010, "Station Name"),
    (0x0008, 0x1030, "Study Description"),
    (0x0008, 0x103E, "Series Description"),
    (0x0008, 0x1090, "Manufacturer's Model Name"),
    (0x0008, 0x2111, "Derivation Description"),
    (0x0010, 0x0010, "Patient's Name"),
    (0x0010, 0x0020, "Patient ID"),
    (0x0010, 0x0030, "Patient's Birth Date"),
    (0x0010, 0x0040, "Patient's Sex"),
    (0x0010, 0x1010, "Patient's Age"),
    (0x0010, 0x1020, "Patient's Size"),
    (0x0010, 0x1030, "Patient's Weight"),
    (0x0010, 0x4000, "Patient Comments"),
    (0x0018, 0x0015, "Body Part Examined"),
    (0x0018, 0x0050, "Slice Thickness"),
    (0x0018, 0x0060, "KVP"),
    (0x0018, 0x0080, "Repetition Time"),
    (0x0018, 0x0081, "Echo Time"),
    (0x0018, 0x0087, "Magnetic Field Strength"),
    (0x0018, 0x0088, "Spacing Between Slices"),
    (0x0018, 0x1000, "Device Serial Number"),
    (0x0018, 0x1020, "Software Versions"),
    (0x0018, 0x1030, "Protocol Name"),
    (0x0018, 0x1150, "Exposure Time"),
    (0x0018, 0x1151, "X-Ray Tube Current"),
    (0x0018, 0x1164, "Imager Pixel Spacing"),
    (0x0018, 0x5100, "Patient Position"),
    (0x0020, 0x000D, "Study Instance UID"),
    (0x0020, 0x000E, "Series Instance UID"),
    (0x0020, 0x0010, "Study ID"),
    (0x0020, 0x0011, "Series Number"),
    (0x0020, 0x0012, "Acquisition Number"),
    (0x0020, 0x0013, "Instance Number"),
    (0x0020, 0x0020, "Patient Orientation"),
    (0x0020, 0x0032, "Image Position (Patient)"),
    (0x0020, 0x0037, "Image Orientation (Patient)"),
    (0x0020, 0x0052, "Frame of Reference UID"),
    (0x0020, 0x1041, "Slice Location"),
    (0x0020, 0x4000, "Image Comments"),
    (0x0028, 0x0002, "Samples per Pixel"),
    (0x0028, 0x0004, "Photometric Interpretation"),
    (0x0028, 0x0006, "Planar Configuration"),
    (0x0028, 0x0008, "Number of Frames"),
    (0x0028, 0x0010, "Rows"),
    (0x0028, 0x0011, "Columns"),
    (0x0028, 0x0030, "Pixel Spacing"),
    (0x0028, 0x0034, "Pixel Aspect Ratio"),
    (0x0028, 0x0100, "Bits Allocated"),
    (0x0028, 0x0101, "Bits Stored"),
    (0x0028, 0x0102, "High Bit"),
    (0x0028, 0x0103, "Pixel Representation"),
    (0x0028, 0x0106, "Smallest Image Pixel Value"),
    (0x0028, 0x0107, "Largest Image Pixel Value"),
    (0x0028, 0x1050, "Window Center"),
    (0x0028, 0x1051, "Window Width"),
    (0x0028, 0x1052, "Rescale Intercept"),
    (0x0028, 0x1053, "Rescale Slope"),
    (0x0028, 0x1054, "Rescale Type"),
    (0x0028, 0x2110, "Lossy Image Compression"),
    (0x0028, 0x2112, "Lossy Image Compression Ratio"),
    (0x7FE0, 0x0010, "Pixel Data"),
    (0xFFFE, 0xE000, "Item"),
    (0xFFFE, 0xE00D, "Item Delimitation Item"),
    (0xFFFE, 0xE0DD, "Sequence Delimitation Item"),
)

# DICOM transfer syntax UIDs: value, text.
DICOM_TRANSFER_SYNTAXES = (
    ("1.2.840.10008.1.2", "Implicit VR Little Endian"),
    ("1.2.840.10008.1.2.1", "Explicit VR Little Endian"),
    ("1.2.840.10008.1.2.1.99", "Deflated Explicit VR Little Endian"),
    ("1.2.840.10008.1.2.2", "Explicit VR Big Endian"),
    ("1.2.840.10008.1.2.4.50", "JPEG Baseline (Process 1)"),
    ("1.2.840.10008.1.2.4.51", "JPEG Extended (Process 2 & 4)"),
    ("1.2.840.10008.1.2.4.52", "JPEG Extended (Process 3 & 5) (Retired)"),
    ("1.2.840.10008.1.2.4.53", "JPEG Spectral Selection, Non-Hierarchical (Process 6 & 8) (Retired)"),
    ("1.2.840.10008.1.2.4.54", "JPEG Spectral Selection, Non-Hierarchical (Process 7 & 9) (Retired)"),
    ("1.2.840.10008.1.2.4.55", "JPEG Full Progression, Non-Hierarchical (Process 10 & 12) (Retired)"),
    ("1.2.840.10008.1.2.4.56", "JPEG Full Progression, Non-Hierarchical (Process 11 & 13) (Retired)"),
    ("1.2.840.10008.1.2.4.57", "JPEG Lossless, Non-Hierarchical (Process 14)"),
    ("1.2.840.10008.1.2.4.58", "JPEG Lossless, Non-Hierarchical (Process 15) (Retired)"),
    ("1.2.840.10008.1.2.4.59", "JPEG Extended, Hierarchical (Process 16 & 18) (Retired)"),
    ("1.2.840.10008.1.2.4.60", "JPEG Extended, Hierarchical (Process 17 & 19) (Retired)"),
    ("1.2.840.10008.1.2.4.61", "JPEG Spectral Selection, Hierarchical (Process 20 & 22) (Retired)"),
    ("1.2.840.10008.1.2.4.62", "JPEG Spectral Selection, Hierarchical (Process 21 & 23) (Retired)"),
    ("1.2.840.10008.1.2.4.63", "JPEG Full Progression, Hierarchical (Process 24 & 26) (Retired)"),
    ("1.2.840.10008.1.2.4.64", "JPEG Full Progression, Hierarchical (Process 25 & 27) (Retired)"),
    ("1.2.840.10008.1.2.4.65", "JPEG Lossless, Hierarchical (Process 28) (Retired)"),
    ("1.2.840.10008.1.2.4.66", "JPEG Lossless, Hierarchical (Process 29) (Retired)"),
    ("1.2.840.10008.1.2.4.70",
     "JPEG Lossless, Non-Hierarchical, First-Order Prediction (Process 14 [Selection Value 1])"),
    ("1.2.840.10008.1.2.4.80", "JPEG-LS Lossless Image Compression"),
    ("1.2.840.10008.1.2.4.81", "JPEG-LS Lossy (Near-Lossless) Image Compression"),
    ("1.2.840.10008.1.2.4.90", "JPEG 2000 Image Compression (Lossless Only)"),
    ("1.2.840.10008.1.2.4.91", "JPEG 2000 Image Compression"),
    ("1.2.840.10008.1.2.4.92", "JPEG 2000 Part 2 Multi-component Image Compression (Lossless Only)"),
    ("1.2.840.10008.1.2.4.93", "JPEG 2000 Part 2 Multi-component Image Compression"),
    ("1.2.840.10008.1.2.4.94", "JPIP Referenced"),
    ("1.2.840.10008.1.2.4.95", "JPIP Referenced Deflate"),
    ("1.2.840.10008.1.2.4.100", "MPEG2 Main Profile @ Main Level"),
    ("1.2.840.10008.1.2.4.101", "MPEG2 Main Profile @ High Level"),
    ("1.2.840.10008.1.2.4.102", "MPEG-4 AVC/H.264 High Profile / Level 4.1"),
    ("1.2.840.10008.1.2.4.103", "MPEG-4 AVC/H.264 BD-compatible High Profile / Level 4.1"),
    ("1.2.840.10008.1.2.5", "RLE Lossless"),
    ("1.2.840.10008.1.2.6.1", "RFC 2557 MIME encapsulation"),
    ("1.2.840.10008.1.2.6.2", "XML Encoding"),
)
# -----------------------------------------------------------------------------------------------


def zigzag_order() -> list[int]:
    """Row-order position of each zigzag index: anti-diagonals, walked in alternating direction."""
    def key(pos: int):
        y, x = divmod(pos, 8)
        return (y + x, y if (y + x) % 2 else x)

    return sorted(range(64), key=key)


ZIGZAG = tuple(zigzag_order())
UNZIGZAG = tuple(ZIGZAG.index(p) for p in range(64))
ROTATE = tuple((p % 8) * 8 + p // 8 for p in range(64))


def idct_weights() -> list[list[float]]:
    """weights[yx][vu] = C(u)·C(v)·cos·cos / 4 with the constant term left out."""
    def c(k: int) -> float:
        return math.sqrt(0.5) if k == 0 else 1.0

    def term(yx: int, vu: int) -> float:
        (y, x), (v, u) = divmod(yx, 8), divmod(vu, 8)
        if vu == 0:
            return 0.0
        return 0.25 * c(u) * c(v) * math.cos((2 * x + 1) * u * math.pi / 16) * math.cos((2 * y + 1) * v * math.pi / 16)

    return [[term(yx, vu) for vu in range(64)] for yx in range(64)]


def int_array(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def marker_name(code: int) -> str:
    """Name of a JPEG marker from its T.81 range."""
    if 0xC0 <= code <= 0xCF:
        return {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC"}.get(code, f"SOF{code - 0xC0}")
    if 0xD0 <= code <= 0xD7:
        return f"RST{code - 0xD0}"
    if 0xE0 <= code <= 0xEF:
        return f"APP{code - 0xE0}"
    if 0xF0 <= code <= 0xFD:
        return f"JPG{code - 0xF0}"
    named = {0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP",
             0x01: "TEM", 0xFE: "COM"}
    return named.get(code, "RES")


def marker_name_column(code: Column) -> Column:
    """``marker_name`` as an expression, so that no join is needed."""
    table = F.array(*[F.lit(marker_name(c)) for c in range(0xC0, 0xFF)])
    return F.when(code.between(0xC0, 0xFE), F.get(table, code - 0xC0)).when(code == 0x01, "TEM").otherwise("RES")


def local_rows(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Rows as a local relation: the optimizer sees their exact size."""
    fields = [f.strip().split() for f in schema.split(",")]
    kinds = {"INT": pa.int32(), "BIGINT": pa.int64(), "STRING": pa.string()}
    columns = list(zip(*rows))
    table = pa.table({n: pa.array(c, kinds[t]) for (n, t), c in zip(fields, columns)})
    return spark.createDataFrame(table)


def dim_iptc(spark: SparkSession) -> DataFrame:
    return local_rows(spark, IPTC_FIELDS, "record INT, dataset INT, type STRING, name STRING")


def dim_resource(spark: SparkSession) -> DataFrame:
    rows = [(c, e, n, i) for i, (c, e, n) in enumerate(RESOURCE_IDS)]
    return local_rows(spark, rows, "code INT, code_end INT, name STRING, ordinal INT")


def key_to_int(key) -> int:
    """Four-character keys are big-endian unsigned numbers."""
    return int.from_bytes(key.encode("ascii"), "big") if isinstance(key, str) else int(key)


def dim_psd_enum(spark: SparkSession) -> DataFrame:
    rows = [(f, key_to_int(v), t) for f, v, t in PSD_ENUMS]
    return local_rows(spark, rows, "field STRING, value BIGINT, text STRING")


def dim_resource_fields(spark: SparkSession) -> DataFrame:
    """Field layout of the typed resource payloads; n is the place of a field within its block."""
    plain = [(b, f, k, at, w, 0, 0, 0, 0, None, None) for b, f, k, at, w in RESOURCE_FIELDS]
    behind = [(b, f, k, at, w, skip, 0, 0, 0, None, None) for b, f, k, at, w, skip in RESOURCE_FIELDS_BEHIND_TEXT]
    lists = [(b, f, k, at, w, 0, *rest) for b, f, k, at, w, *rest in RESOURCE_LISTS]
    rows, seen = [], {}
    for b, f, k, *rest in plain + behind + lists:
        n = seen[b] = seen.get(b, -1) + 1
        kind, _, enum = k.partition(":")
        rows.append((b, n, f, kind, enum, *rest))
    return local_rows(
        spark, rows,
        "bim_id INT, n INT, field STRING, kind STRING, enum STRING, at INT, width INT, skip_wide INT, stride INT, per INT, start INT, "
        "count_at INT, count_width INT",
    )


def dim_exif(spark: SparkSession) -> DataFrame:
    return local_rows(spark, EXIF_TAGS, "section STRING, tag_id INT, name STRING")


def dim_dicom(spark: SparkSession, registry: str | None = None) -> DataFrame:
    """(grp, elem, name): the core tags, or a whole registry read from a parquet table of that shape."""
    if registry is not None:
        return spark.read.parquet(registry).select("grp", "elem", "name")
    return local_rows(spark, DICOM_CORE_TAGS, "grp INT, elem INT, name STRING")


def dim_dicom_enum(spark: SparkSession, registry: str | None = None) -> DataFrame:
    """(grp, elem, value, text): transfer syntaxes, or a whole value table read from parquet."""
    if registry is not None:
        return spark.read.parquet(registry).select("grp", "elem", "value", "text")
    rows = [(0x0002, 0x0010, uid, text) for uid, text in DICOM_TRANSFER_SYNTAXES]
    return local_rows(spark, rows, "grp INT, elem INT, value STRING, text STRING")


def dim_zigzag(spark: SparkSession) -> DataFrame:
    rows = [(p, UNZIGZAG[p], ROTATE[p]) for p in range(64)]
    return local_rows(spark, rows, "pos INT, zz INT, rot INT")
