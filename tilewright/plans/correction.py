"""Settings of an image checked and completed before it is written.

Rows of settings go through a cascade of rules; each row leaves with the
settings that a writer uses, or with the first reason why it cannot be written.
Strict mode takes settings as they are or refuses them; smart mode widens
depths to those of a sample type and replaces what cannot be encoded by its
nearest kin.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tags import COMPRESSIONS, PHOTOMETRIC

UNSIGNED, SIGNED, FLOAT, VOID = 1, 2, 3, 4
#: Depths that a strict writer takes for any number of channels.
WHOLE = (8, 16, 32, 64)

PROBLEMS = {
    "depths differ": "channels take different numbers of bytes, or, in strict mode, of bits",
    "no such sample type": "no sample type has this format and depth",
    "depth not written": "strict mode writes single bits of one channel and 8, 16, 32 and 64 bits",
    "float depth not written": "strict mode writes floating-point samples of 32 and 64 bits",
    "compression not written": "there is no encoder",
    "channels of JPEG": "JPEG holds one or three channels",
    "photometric of JPEG": "grey images are black-is-zero, others brightness and colour or RGB",
    "palette without map": "indexed colours need a colour map",
    "photometric of one channel": "one channel is black-is-zero, white-is-zero or a palette",
    "colour differences not encoded": "strict mode does not replace them by RGB",
}


def any_of(c: Column, values) -> Column:
    return c.isin(*values)


def corrected(settings: DataFrame, *, smart: Column | bool = True, writable: set[int] | None = None) -> DataFrame:
    """Adds new_bits, new_format, new_compression, new_photometric and problem to rows of settings.

    Columns: channels int, bits array<int> (null: single bits), sample_format int (null: unsigned), compression int
    (null: none), photometric int (null: not stated), color_map and planar boolean. problem is null where the row can
    be written, else a key of PROBLEMS, and the new settings are null then. new_photometric stays null where nothing
    is known of two, or of five and more, channels.
    """
    smart = F.lit(smart) if isinstance(smart, bool) else smart
    code = {n: c for n, (c, _, _) in COMPRESSIONS.items()}
    writable = writable if writable is not None else {c for c, _, w in COMPRESSIONS.values() if w}
    jpeg, old_jpeg = code["JPEG"], code["OLD_JPEG"]
    required_rgb = (code["JPEG_2000"], code["JPEG_2000_APERIO"])

    bits = F.when(F.size("bits") > 0, F.col("bits")).otherwise(F.array(F.lit(1)))
    first = bits[0]
    kind = F.coalesce("sample_format", F.lit(UNSIGNED))
    size = lambda b: F.floor((b + 7) / 8)  # noqa: E731  bytes of a depth
    same_bytes = F.forall(bits, lambda b: size(b) == size(first))
    same_bits = F.forall(bits, lambda b: b == first)
    depth = F.when((F.size(bits) == 1) & (first == 1), 1).otherwise(size(first) * 8)
    whole = F.when(any_of(depth, (1, 8, 16)), depth).when(any_of(depth, (24, 32)), 32)
    floating = F.when(same_bits & any_of(first, (16, 24, 32)), 32).when(same_bits & (first == 64), 64)
    of_type = F.when(kind == FLOAT, floating).when(any_of(kind, (UNSIGNED, SIGNED, VOID)), whole).cast("int")
    single = (first == 1) & (F.size(bits) == 1)

    asked = F.coalesce("compression", F.lit(code["NONE"]))
    method = F.when(smart & (asked == old_jpeg), jpeg).otherwise(asked)
    p, n = F.col("photometric"), F.col("channels")
    black, white, rgb, palette, colour = (PHOTOMETRIC[x] for x in ("BLACK_IS_ZERO", "WHITE_IS_ZERO", "RGB", "RGB_PALETTE", "Y_CB_CR"))
    is_jpeg = method == jpeg
    low_level = [code[x] for x in ("NONE", "CCITT_RLE", "CCITT_T4", "CCITT_T6", "LZW", "DEFLATE", "OLD_DEFLATE", "PACK_BITS", "THUNDER_SCAN", "LZMA", "ZSTD")]
    differences = (n == 3) & ~is_jpeg & (p == colour) & ((method <= 10) | any_of(method, low_level)) & (method != old_jpeg) & ~any_of(method, required_rgb)

    rules = [
        ("depths differ", ~same_bytes),
        ("no such sample type", of_type.isNull()),
        ("depths differ", ~smart & ~same_bits),
        ("depth not written", ~smart & ~(single | any_of(first, WHOLE))),
        ("float depth not written", ~smart & (kind == FLOAT) & ~any_of(first, (32, 64))),
        ("compression not written", ~any_of(method, sorted(writable))),
        ("channels of JPEG", is_jpeg & ~any_of(n, (1, 3))),
        ("photometric of JPEG", is_jpeg & p.isNotNull() & ~F.when(n == 1, p == black).otherwise(any_of(p, (colour, rgb)))),
        ("palette without map", ~is_jpeg & (n == 1) & (p == palette) & ~F.coalesce("color_map", F.lit(False))),
        ("photometric of one channel", ~is_jpeg & (n == 1) & p.isNotNull() & ~any_of(p, (black, white, palette))),
        ("colour differences not encoded", ~smart & differences),
    ]
    problem = reduce(lambda rest, rule: F.when(F.coalesce(rule[1], F.lit(False)), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit(None).cast("string"))
    suggested = (
        F.when(is_jpeg & p.isNull(), F.when(n == 1, black).when(F.coalesce("planar", F.lit(False)), rgb).otherwise(colour))
        .when(is_jpeg, p)
        .when((n == 1) & p.isNull(), F.when(F.coalesce("color_map", F.lit(False)), palette).otherwise(black))
        .when((n == 3) & (p.isNull() | any_of(method, required_rgb) | F.coalesce(differences, F.lit(False))), rgb)
        .when((n == 4) & p.isNull(), rgb)
        .otherwise(p)
    )
    # a sample type has one format: void becomes unsigned
    new_format = F.when(smart & (kind == VOID), UNSIGNED).otherwise(kind)
    new_bits = F.when(smart, F.transform(bits, lambda _: of_type)).otherwise(bits)
    fine = F.col("problem").isNull()
    out = settings.withColumn("problem", problem)
    for name, value in (("new_bits", new_bits), ("new_format", new_format.cast("int")), ("new_compression", method.cast("int")), ("new_photometric", suggested.cast("int"))):
        out = out.withColumn(name, F.when(fine, value))
    return out
