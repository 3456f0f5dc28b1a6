"""Network address checks, the IPv6 /48 network and IPv4 masking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IPV4_MASK_PATTERN, IPV4_MASK_SUFFIX

_OCTET = r"(25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
IPV4_REGEX = rf"^{_OCTET}(\.{_OCTET}){{3}}\z"

_H = r"[0-9a-fA-F]{1,4}"
# Eight groups, or fewer groups around a single "::" (checked for count separately).
IPV6_FULL_REGEX = rf"^{_H}(:{_H}){{7}}\z"
IPV6_COMPRESSED_REGEX = rf"^({_H}(:{_H})*)?::({_H}(:{_H})*)?\z"

# An IPv6 text whose last two groups are written as a dotted quad (without leading zeros).
_TAIL = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
MIXED_REGEX = rf"^([0-9a-fA-F:]*:){_TAIL}\.{_TAIL}\.{_TAIL}\.{_TAIL}\z"

_MASK_REGEX = IPV4_MASK_PATTERN.replace(r"\d", "[0-9]")[:-1] + r"\z"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _written_groups(s: Column) -> Column:
    """Number of groups written in an IPv6 text (empty pieces around ``::`` not counted)."""
    return F.size(F.filter(F.split(s, ":"), lambda g: g != ""))


def hex_tail(ip: Column | str) -> Column:
    """IPv6 text in mixed notation (``::ffff:1.2.3.4``) with the dotted quad as two groups; other text as it is."""
    s = _c(ip)
    octet = [F.regexp_extract(s, MIXED_REGEX, i).try_cast("int") for i in range(2, 6)]
    group = [F.lower(F.hex(octet[i] * 256 + octet[i + 1])) for i in (0, 2)]
    return F.when(s.rlike(MIXED_REGEX), F.concat(F.regexp_extract(s, MIXED_REGEX, 1), group[0], F.lit(":"), group[1])).otherwise(s)


def is_ipv4(ip: Column | str) -> Column:
    return F.coalesce(_c(ip).rlike(IPV4_REGEX), F.lit(False))


def is_ipv6(ip: Column | str) -> Column:
    """Full form, or one ``::`` standing for at least one zero group (at most seven written); the last two
    groups may be written as a dotted quad."""
    s = hex_tail(ip)
    compressed = s.rlike(IPV6_COMPRESSED_REGEX) & (_written_groups(s) <= 7)
    return F.coalesce(s.rlike(IPV6_FULL_REGEX) | compressed, F.lit(False))


def ipv6_expanded(ip: Column | str) -> Column:
    """Valid IPv6 text with ``::`` written out as zero groups: always eight groups."""
    s = hex_tail(ip)
    zeros = F.concat(F.lit(":"), F.repeat(F.lit("0:"), F.lit(8) - _written_groups(s)))
    return F.regexp_replace(F.regexp_replace(s, "::", zeros), "^:|:$", "")


def ipv6_groups(ip: Column | str) -> Column:
    """The eight 16-bit groups of a valid IPv6 text as lower-case hex without leading zeros."""
    return F.transform(F.split(ipv6_expanded(ip), ":"), lambda g: F.lower(F.conv(g, 16, 16)))


def ipv6_prefix48(ip: Column | str) -> Column:
    """the /48 network of an IPv6 address, collapsed (``2001:db8:1::``; all zero: ``::``).

    The first three groups are kept and the rest zeroed; the longest zero run then always
    contains the five trailing groups, so it is written as ``::`` after the last non-zero
    group among the first three. Each step reads the previous one once, so the expression
    stays small.
    """
    first3 = F.transform(F.slice(F.split(ipv6_expanded(ip), ":"), 1, 3), lambda g: F.lower(F.conv(g, 16, 16)))
    kept = F.regexp_replace(F.array_join(first3, ":"), "(:0)+$", "")
    return F.regexp_replace(F.concat(kept, F.lit("::")), "^0::$", "::")


def mask_ip(ip: Column | str) -> Column:
    """dotted-quad text (no range check) becomes ``first.x.x.x``; other text is unchanged."""
    s = _c(ip)
    return F.when(s.rlike(_MASK_REGEX), F.concat(F.split(s, r"\.").getItem(0), F.lit(IPV4_MASK_SUFFIX))).otherwise(s)
