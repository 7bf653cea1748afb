"""Typed payloads of the resources that the common packed documents lack, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixsieve.operators import extract as ex
from pixsieve.plans import inputs as inp
from pixsieve.plans.packed import _block, be, hx, sealed, text
from pixsieve.sources import dims


def resource_files(spark, sf_dir: str) -> DataFrame:
    """Parts as documents with thirteen resources: print flags, layer groups, a thumbnail's header, texts, lists, numbers."""
    p = inp.spread(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")

    def wide(v):
        return F.concat(be(F.length(v), 4), F.encode(v, "UTF-16BE"))

    def listed(count, value, width: int):
        items = F.transform(F.sequence(F.lit(1), count), lambda i: F.lpad(F.hex(value(i - 1)), 2 * width, "0"))
        return F.when(count > 0, F.unhex(F.array_join(items, ""))).otherwise(hx(""))

    blocks = (
        (0x03F3, F.concat(*[be((k + i) % 2, 1) for i in range(9)])),
        (0x0400, be(size, 2)),
        (0x0402, listed((k % 4).cast("int"), lambda i: size + i, 2)),
        (0x040A, be(k % 2, 1)),
        (0x040C, F.concat(be(1, 4), be(size, 4), be(size + 1, 4), be(size * 3, 4), be(size * 4, 4), be(k, 4), be(24, 2), be(1, 2), hx("FFD8FF"))),
        (0x040D, be(k % 360, 4)), (0x0414, be(k, 4)), (0x0415, wide(F.col("p_name"))), (0x0419, be(size, 4)), (0x041B, wide(F.col("p_brand"))),
        (0x0424, text(F.concat(F.lit("<x>"), "p_name", F.lit("</x>")))),
        (0x0430, listed((k % 3 + 1).cast("int"), lambda i: (k + i) % 2, 1)),
        (0x2710, F.concat(be(1, 2), be(k % 2, 1), hx("00"), be(size * 65536, 4), be(2, 2))),
    )
    res = F.concat(*[_block(code, "", data) for code, data in blocks])
    p = p.select("p_partkey", sealed(res, "res"))
    content = F.concat(hx("38425053 0001 000000000000 0003 00000001 00000001 0008 0003 00000000"), be(F.length("res"), 4), "res", hx("00000000 0000 010203"))
    return p.select(F.col("p_partkey").alias("path"), sealed(content, "content"))


def psd_payloads_rest(spark, d):
    resources = ex.psd_resources(resource_files(spark, d), dims.dim_resource(spark))
    return ex.resource_fields(resources, dims.dim_resource_fields(spark), dims.dim_psd_enum(spark))


QUERIES = {"psd_payloads_rest": psd_payloads_rest}

_BOOL = "CASE WHEN {} = 1 THEN 'true' ELSE 'false' END"
_FLAGS = ("labels", "crop_marks", "color_bars", "registration_marks", "negative", "flip", "interpolate", "caption", "print_flags")
#: Place among the blocks, id, fields with their text.
_FIELDS = (
    (0, 0x03F3, [(name, _BOOL.format(f"(p_partkey + {i}) % 2")) for i, name in enumerate(_FLAGS)]),
    (1, 0x0400, [("target_layer", "p_size")]),
    (3, 0x040A, [("copyright", _BOOL.format("p_partkey % 2"))]),
    (4, 0x040C, [("format", "1"), ("width", "p_size"), ("height", "p_size + 1"), ("width_bytes", "p_size * 3"), ("total_size", "p_size * 4"),
                 ("compressed_size", "p_partkey"), ("bits_per_pixel", "24"), ("planes", "1"), ("jfif_offset", "28")]),
    (5, 0x040D, [("angle", "p_partkey % 360")]), (6, 0x0414, [("seed", "p_partkey")]), (7, 0x0415, [("text", "p_name")]), (8, 0x0419, [("altitude", "p_size")]),
    (9, 0x041B, [("text", "p_brand")]), (10, 0x0424, [("xmp", "'<x>' || p_name || '</x>'")]),
    (12, 0x2710, [("version", "1"), ("center_crop_marks", "p_partkey % 2"), ("reserved", "0"), ("bleed_width", "p_size * 65536"), ("bleed_scale", "2")]),
)
_ROW = "SELECT p_partkey AS path, {seq} AS seq, {code} AS bim_id, CAST({n} AS INTEGER) AS n, '{name}' AS field, CAST({value} AS VARCHAR) AS value FROM part{more}"

ORACLE = {
    "psd_payloads_rest": " UNION ALL ".join(
        [_ROW.format(seq=seq, code=code, n=n, name=name, value=value, more="") for seq, code, fields in _FIELDS for n, (name, value) in enumerate(fields)]
        + [_ROW.format(seq=2, code=0x0402, n="r.i", name="layer_group", value="p_size + r.i", more=", range(4) r(i) WHERE r.i < p_partkey % 4"),
           _ROW.format(seq=11, code=0x0430, n="r.i", name="layer_enabled", value="(p_partkey + r.i) % 2", more=", range(4) r(i) WHERE r.i < p_partkey % 3 + 1")])
}
