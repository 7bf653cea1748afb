"""Scalar helpers as column expressions, all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- bits ----------------------------------------------------------------------------------------

def to_binary(v: Column, width: int, spaced: bool = False) -> Column:
    """Binary digits, most significant first, optionally with a space between bytes."""
    digits = F.lpad(F.right(F.bin(v), F.lit(width)), width, "0")
    return F.regexp_replace(digits, "(?<=.)(?=(.{8})+$)", " ") if spaced else digits


def test_bit(v: Column, bit: int) -> Column:
    return F.getbit(v, F.lit(bit)) == 1


def extract_bits(word: Column, bits: Column) -> Column:
    """The leftmost bits of a 32-bit word, given as an unsigned BIGINT."""
    return F.floor(word / F.pow(F.lit(2.0), F.lit(32) - bits)).cast("bigint")


def left_mask(bits: Column) -> Column:
    """Mask of the leftmost bits of a 32-bit word, as an unsigned BIGINT."""
    return (F.lit(1 << 32) - F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")).cast("bigint")


def signed_value(v: Column, bits: Column) -> Column:
    """Variable-length signed value of a code with that many extra bits; zero bits give 0."""
    half = F.pow(F.lit(2.0), bits - 1).cast("bigint")
    full = F.pow(F.lit(2.0), bits).cast("bigint")
    return F.when(bits == 0, F.lit(0).cast("bigint")).when(v >= half, v.cast("bigint")).otherwise(v - (full - 1))


def scale_precision(v: Column, precision: Column) -> Column:
    """Sample of more than 8 bits to 8 bits, truncating toward zero."""
    return (v / F.pow(F.lit(2.0), F.greatest(precision - 8, F.lit(0)))).cast("int")


def zero_run(code: Column) -> Column:
    return F.shiftright(code, 4)


def extra_bits(code: Column) -> Column:
    return code.bitwiseAND(15)


def is_end_of_block(code: Column) -> Column:
    return code == 0


# --- text ----------------------------------------------------------------------------------------

def four_chars(v: Column) -> Column:
    """'abcd' (0x61626364): a 32-bit number as characters, zero bytes as dots."""
    digits = F.lpad(F.hex(v), 8, "0")
    chars = F.replace(F.decode(F.unhex(digits), "ISO-8859-1"), F.lit("\x00"), F.lit("."))
    return F.concat(F.lit("'"), chars, F.lit("' (0x"), digits, F.lit(")"))


def dotted_bytes(v: Column) -> Column:
    parts = [F.shiftright(v, s).bitwiseAND(255) for s in (24, 16, 8, 0)]
    return F.format_string("'%d.%d.%d.%d' (0x%08X)", *parts, v)


def parse_uint32(text: Column, base: int) -> Column:
    """Unsigned number in base 10 or 16 (optional 0x), null when any character is foreign."""
    t = F.upper(text)
    if base == 16:
        t = F.regexp_replace(t, "^0X", "")
        return F.when(t.rlike("^[0-9A-F]{1,8}$"), F.conv(t, 16, 10).cast("bigint"))
    if base == 10:
        return F.when(t.rlike("^[0-9]{1,10}$"), t.cast("bigint"))
    raise ValueError("base must be 10 or 16")


def place(v: Column) -> Column:
    """A position or length as substring takes it: numbers of damaged files beyond 31 bits stand where no content is."""
    return F.least(v.cast("bigint"), F.lit(0x7FFFFFFF).cast("bigint")).cast("int")


def fixed_string(content: Column, offset: Column, length: Column) -> Column:
    """Printable text of a fixed field: stops at a zero byte, drops other non-printables."""
    text = F.decode(F.substring(content, place(offset + 1), place(length)), "ISO-8859-1")
    return F.regexp_replace(F.substring_index(text, "\x00", 1), "[^\\x20-\\x7e]", "")


def terminated_string(content: Column, offset: Column, limit: int = 255) -> Column:
    """Text up to a zero byte, at most ``limit`` bytes long."""
    return F.substring_index(F.decode(F.substring(content, place(offset + 1), F.lit(limit)), "ISO-8859-1"), "\x00", 1)


def wide_string(content: Column, offset: Column, chars: Column, big_endian: bool = True) -> Column:
    """16-bit text of that many characters."""
    data = F.substring(content, place(offset + 1), place(chars * 2))
    return F.decode(data, "UTF-16BE" if big_endian else "UTF-16LE")


def terminated_wide_string(content: Column, offset: Column, limit: int = 255, big_endian: bool = False) -> Column:
    """16-bit text up to a zero character, at most ``limit`` characters long."""
    return F.substring_index(wide_string(content, offset, F.lit(limit), big_endian), "\x00", 1)


def length_prefixed_ascii(content: Column, offset: Column) -> Column:
    """u32 length and text; length 0 means a four-character code."""
    n = read_uint(content, offset, 4)
    size = F.when(n == 0, F.lit(4)).otherwise(n)
    return F.decode(F.substring(content, place(offset + 5), place(size)), "ISO-8859-1")


def length_prefixed_wide(content: Column, offset: Column, shown: int | None = None) -> Column:
    """u32 character count and UTF-16BE text, whole as far as the bytes go; ``shown`` clips it for display."""
    there = F.floor((F.length(content) - offset - 4) / 2)
    n = F.greatest(F.least(read_uint(content, offset, 4), there), F.lit(0))
    text = wide_string(content, offset + 4, n)
    return text if shown is None else F.left(text, F.lit(shown))


def bool_text(v: Column) -> Column:
    return F.when(v != 0, "true").when(v == 0, "false")


def position_text(byte: Column, bit: Column) -> Column:
    return F.format_string("0x%08X.%d", byte, bit)


# --- numbers in bytes ----------------------------------------------------------------------------

def unsigned(data: Column) -> Column:
    """The number in up to 8 bytes, high byte first; 8 bytes from 2^63 on wrap to negative numbers."""
    digits = F.hex(data)
    small = F.conv(digits, 16, 10).try_cast("bigint")
    high, low = (F.conv(F.substring(digits, a, 8), 16, 10).cast("bigint") for a in (1, 9))
    return F.when(F.length(data) == 8, F.shiftleft(high, 32).bitwiseOR(low)).otherwise(small)


def read_uint(content: Column, offset: Column | int, width: int, little: bool = False) -> Column:
    """Unsigned number of 1, 2, 4 or 8 bytes at a zero-based offset; null when the bytes are not all there."""
    at = place(offset + 1) if isinstance(offset, Column) else F.lit(offset + 1)
    data = F.substring(content, at, F.lit(width))
    digits = F.hex(data)
    if little:
        digits = F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))])
    return F.when(F.length(data) == width, unsigned(F.unhex(digits)) if width == 8 else F.conv(digits, 16, 10).cast("bigint"))


def read_int16(content: Column, offset: Column | int) -> Column:
    u = read_uint(content, offset, 2)
    return F.when(u >= 32768, u - 65536).otherwise(u)


def fixed_point(v: Column) -> Column:
    """16.16 fixed point."""
    return v / F.lit(65536.0)


def _ieee(sign: Column, exponent: Column, fraction: Column, bias: int, digits: int) -> Column:
    one = F.lit(1.0)
    unit = F.pow(F.lit(2.0), F.lit(-float(digits)))
    normal = (one + fraction * unit) * F.pow(F.lit(2.0), exponent - bias)
    tiny = fraction * unit * F.pow(F.lit(2.0), F.lit(1.0 - bias))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(exponent == 0, tiny).when(exponent == 2 * bias + 1, special).otherwise(normal)
    return F.when(sign == 1, -value).otherwise(value)


def float32(v: Column) -> Column:
    """IEEE single from its 32 bits (unsigned BIGINT)."""
    return _ieee(F.shiftright(v, 31), F.shiftright(v, 23).bitwiseAND(255), v.bitwiseAND((1 << 23) - 1), 127, 23)


def float64(hi: Column, lo: Column) -> Column:
    """IEEE double from its two 32-bit halves (unsigned BIGINTs)."""
    fraction = F.shiftleft(hi.bitwiseAND((1 << 20) - 1), 32) + lo
    return _ieee(F.shiftright(hi, 31), F.shiftright(hi, 20).bitwiseAND(2047), fraction, 1023, 52)


def save_quality(word: Column) -> Column:
    """Save quality 1..12 from its stored 16-bit word (which starts at -3), else 0."""
    q = (word + 4) % 65536
    return F.when(q.between(1, 12), q).otherwise(F.lit(0))


def save_format(word: Column) -> Column:
    return F.when(word == 0, "Standard").when(word == 1, "Optimized").when(word == 0x101, "Progressive").otherwise("???")


def save_scans(word: Column) -> Column:
    return F.when(word.between(1, 3), F.concat((word + 2).cast("string"), F.lit(" Scans"))).otherwise("???")


def rational(num: Column, den: Column) -> Column:
    return F.try_divide(num, den)


def fraction_text(num: Column, den: Column) -> Column:
    """A fraction as text: whole numbers plainly, others as num/den; a zero denominator stays visible."""
    safe = F.when(den == 0, F.lit(1)).otherwise(den)
    whole = (den != 0) & (num % safe == 0)
    return F.when(whole, (num / safe).cast("bigint").cast("string")).otherwise(F.concat_ws("/", num.cast("string"), den.cast("string")))


def dms_text(d: Column, m: Column, s: Column) -> Column:
    """Degrees, minutes and seconds as text."""
    return F.format_string("%d deg %d' %.3f\"", d.cast("bigint"), m.cast("bigint"), s.cast("double"))


def degrees(d: Column, m: Column, s: Column) -> Column:
    return d + m / F.lit(60.0) + s / F.lit(3600.0)


# --- positions -----------------------------------------------------------------------------------

def pack_offset(byte: Column, bit: Column) -> Column:
    return F.shiftleft(byte.cast("bigint"), 4) + bit


def unpack_byte(packed: Column) -> Column:
    return F.shiftright(packed, 4)


def unpack_bit(packed: Column) -> Column:
    return packed.bitwiseAND(7).cast("int")


def cell_of(x: Column, size: int) -> Column:
    """Index of the MCU or block that holds a pixel coordinate."""
    return F.floor(x / F.lit(size)).cast("int")


def linear_index(x: Column, y: Column, per_row: Column | int) -> Column:
    return y * per_row + x


# --- digests and URLs ----------------------------------------------------------------------------

def md5_upper(data: Column) -> Column:
    return F.upper(F.md5(data))


# ASCII characters escaped in a URL besides the control range 1..32 and 124..127.
URL_UNSAFE = "%=\"<>\\^[]`+$,@:;/!#?&'"


def url_escape(text: Column) -> Column:
    """Percent-encode the unsafe ASCII set; characters above it are encoded as UTF-8 bytes."""
    kept = "".join(chr(c) for c in range(33, 124) if chr(c) not in URL_UNSAFE)
    spelled = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for c in kept:
        if not (c.isalnum() or c in "-_.*"):
            spelled = F.replace(spelled, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return spelled


def url_unescape(text: Column) -> Column:
    """Decode percent escapes; a plus sign stays a plus sign."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
