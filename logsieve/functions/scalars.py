"""Scalar helpers: JSON text length, stable hash codes, address ranges, timestamps, empty-as-missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"

# IPv4 blocks that are not globally reachable, as (first address, prefix length).
PRIVATE_V4 = [
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
]
# Public addresses inside one of the blocks above.
PUBLIC_V4 = ["192.0.0.9", "192.0.0.10"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_V4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Missing text as the empty string."""
    return F.coalesce(col(c), F.lit(""))


def non_empty(c: Column | str) -> Column:
    """Empty text as missing, so `coalesce` picks the first value that says something."""
    return F.nullif(col(c), F.lit(""))


def iso_timestamp(c: Column | str) -> Column:
    """Strict `2024-01-31T08:00:00Z`; anything else is null."""
    return F.try_to_timestamp(col(c), F.lit(ISO_FORMAT))


def epoch_ms(c: Column | str) -> Column:
    return F.timestamp_millis(col(c).cast("bigint"))


def head(c: Column | str, n: int) -> Column:
    return F.substring(col(c), 1, n)


def compact_json(c: Column | str) -> Column:
    """JSON text without insignificant blanks; text that does not parse is kept as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(col(c))), col(c))


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def json_len(c: Column | str, compact: bool = False, ascii_escapes: bool = True) -> Column:
    """Length of a JSON document printed with `", "` and `": "` separators.

    With `ascii_escapes` every character beyond ASCII counts as its `\\uXXXX` escape, and a character beyond
    the basic plane as two of them. Set `compact` when the text has no blanks between tokens already.
    """
    def escapes(j: Column) -> Column:
        beyond_ascii = F.length(F.regexp_replace(j, r"[\x00-\x7F]", ""))
        beyond_plane = F.length(F.regexp_replace(j, r"[\x{0}-\x{FFFF}]", ""))
        return F.when(F.octet_length(j) == F.length(j), 0).otherwise(5 * beyond_ascii + 6 * beyond_plane)

    def printed(j: Column) -> Column:
        # Two flat loops: an alternation inside a repeated group would recurse once per character.
        skeleton = F.regexp_replace(F.regexp_replace(j, r"(?s)\\.", ""), r'"[^"]*"', "S")
        separators = let(skeleton, lambda s: F.length(s) - F.length(F.translate(s, ",:", "")))
        n = F.length(j) + separators
        return n + escapes(j) if ascii_escapes else n

    return printed(col(c)) if compact else let(compact_json(c), printed)


def _escape(char: Column) -> Column:
    """One character as JSON prints it in ASCII."""
    code = F.ascii(char)
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    rest = code - 0x10000
    pair = F.concat(unit(F.lit(0xD800) + F.shiftright(rest, 10)), unit(F.lit(0xDC00) + rest.bitwiseAND(0x3FF)))
    return F.when(code < 128, char).when(code < 0x10000, unit(code)).otherwise(pair)


# A JSON string, matched without backtracking and so without recursion, however long it is.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def printed_json(c: Column | str, compact: bool = False) -> Column:
    """A JSON document printed with `", "` and `": "` separators and ASCII escapes."""
    j = col(c) if compact else compact_json(c)
    spaced = F.regexp_replace(j, rf"(?s)({_STRING})|([,:])", "$1$2 ")
    spaced = F.rtrim(F.regexp_replace(spaced, rf"(?s)({_STRING}) (?=[,:}}\]])", "$1"))
    escaped = F.array_join(F.transform(F.split(spaced, ""), _escape), "")
    return F.when(spaced.rlike(r"[^\x00-\x7F]"), escaped).otherwise(spaced)


def md5_mod(c: Column | str, n: int = 1000) -> Column:
    """The 128-bit MD5 of a text as an integer, modulo n, folded from pieces that fit a long."""
    digest = F.md5(col(c))
    pieces = [(1, 15), (16, 15), (31, 2)]
    values = [(F.conv(F.substring(digest, at, size), 16, 10).cast("bigint"), pow(16, size, n)) for at, size in pieces]
    return reduce(lambda acc, v: (acc * v[1] + v[0]) % n, values, F.lit(0).cast("bigint")).cast("int")


def unit_hash(*parts: Column | str) -> Column:
    """52 bits of MD5 as a double: exact, uniform, and the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[col(p) for p in parts])), 1, 13), 16, 10).cast("double")


def _block_prefix(address: str, bits: int) -> str:
    """The pattern that the dotted text of every address of a block starts with."""
    octets = [int(o) for o in address.split(".")]
    whole, rest = divmod(bits, 8)
    parts = [str(o) for o in octets[:whole]]
    if rest:
        low = octets[whole]
        parts.append("(?:" + "|".join(str(o) for o in range(low, low + 2 ** (8 - rest))) + ")")
    return r"\.".join(parts) + r"\."


_PRIVATE_PREFIX = "^(?:" + "|".join(_block_prefix(a, bits) for a, bits in PRIVATE_V4) + ")"


def _v4_private(ip: Column) -> Column:
    return ip.rlike(_PRIVATE_PREFIX) & ip.rlike(_V4) & ~ip.isin(PUBLIC_V4)


def _v6_private(ip: Column) -> Column:
    mapped = F.regexp_extract(ip, r"^(?:0{0,4}:){0,5}:?ffff:(\d+\.\d+\.\d+\.\d+)$", 1)
    local = (
        ip.isin("::", "::1", "0:0:0:0:0:0:0:0", "0:0:0:0:0:0:0:1")
        | ip.rlike(r"^f[cd][0-9a-f]{2}:")
        | ip.rlike(r"^fe[89ab][0-9a-f]:")
        | ip.rlike(r"^2001:0?db8:")
        | ip.rlike(r"^2002:")
        | ip.rlike(r"^100::")
        | (ip.rlike(r"^2001:(0{0,4}:|:|0{0,1}1?[0-9a-f]{1,2}:)")
           & ~ip.rlike(r"^2001:0{0,3}(1::[12]$|3:|4:112:)|^2001:0{0,2}[23][0-9a-f]:"))
    )
    well_formed = ip.rlike(r"^[0-9a-f:.]+$") & ip.contains(":") & ~ip.rlike(r":::|::.*::")
    return well_formed & (local | _v4_private(mapped))


def is_private_ip(c: Column | str) -> Column:
    """1 for an address that is not globally reachable, 0 for any other address and for a host name."""
    ip = text(c)
    private = F.when(ip.contains(":"), _v6_private(F.lower(ip))).otherwise(_v4_private(ip))
    return F.coalesce(private.cast("int"), F.lit(0))


def has_private_prefix(c: Column | str) -> Column:
    """The prefix form of the test; it also takes 172.32.0.0 and above for private."""
    return text(c).rlike(r"^(10\.|172\.|192\.168\.)").cast("int")
