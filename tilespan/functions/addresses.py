"""IP addresses as native columns: literals to numbers, the block an address lies in, IPv4 addresses held by IPv6 ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Address blocks by kind (the registries of special-purpose addresses), the first that holds an address names it.
BLOCKS = {
    "link_local": (("169.254.0.0", 16),),
    "multicast": (("224.0.0.0", 4),),
    "unspecified": (("0.0.0.0", 32),),
    "loopback": (("127.0.0.0", 8),),
    "private": (("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("0.0.0.0", 8), ("192.0.0.0", 24), ("192.0.2.0", 24), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24)),
    "reserved": (("240.0.0.0", 4),),
}
GLOBAL_WITHIN = (("192.0.0.9", 32), ("192.0.0.10", 32))
BLOCKS6 = {
    "link_local": (("fe80", 10),),
    "multicast": (("ff00", 8),),
    "unspecified": (("0", 128),),
    "loopback": (("0:0:0:0:0:0:0:1", 128),),
    "private": (("64:ff9b:1", 48), ("100", 64), ("2001", 23), ("2001:db8", 32), ("2002", 16), ("fc00", 7)),
    "reserved": (("0", 8), ("100", 8), ("200", 7), ("400", 6), ("800", 5), ("1000", 4), ("4000", 3), ("6000", 3), ("8000", 3), ("a000", 3), ("c000", 3), ("e000", 4), ("f000", 5), ("f800", 6), ("fe00", 9)),
}
GLOBAL_WITHIN6 = (("2001:1:0:0:0:0:0:1", 128), ("2001:1:0:0:0:0:0:2", 128), ("2001:3", 32), ("2001:4:112", 48), ("2001:20", 28), ("2001:30", 28))
#: Kinds that no one may fetch from, and those that a local network may be opened to.
NEVER = ("link_local", "multicast", "unspecified")
LOCAL = ("loopback", "private", "reserved")


def let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value worked out once however often make names it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def ipv4(host: Column) -> Column:
    """An IPv4 literal as a number, null for other hosts."""
    octet = lambda p: F.when(p.rlike("^(0|[1-9][0-9]{0,2})$") & (p.try_cast("int") <= 255), p.cast("long"))
    total = lambda octets: F.when((F.size(octets) == 4) & F.forall(octets, lambda o: o.isNotNull()), F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o))
    return let(F.transform(F.split(host, r"\."), octet), total)


def ipv6(host: Column) -> Column:
    """struct<hi, lo>: the halves of an IPv6 literal as bit patterns, null for other hosts. A zone (%eth0) is left out."""
    dots = r"(?<=:)[0-9.]*\.[0-9.]*$"

    def plain(raw: Column) -> Column:
        """Without a dotted tail: that is two groups."""
        groups = lambda tail: F.when(tail.isNotNull(), F.concat(F.regexp_replace(raw, dots, ""), F.lower(F.hex(F.shiftright(tail, 16))), F.lit(":"), F.lower(F.hex(tail.bitwiseAND(F.lit(0xFFFF).cast("long"))))))
        return F.when(raw.rlike(dots), let(ipv4(F.regexp_extract(raw, f"({dots})", 1)), groups)).otherwise(raw)

    def groups(text: Column) -> Column:
        """The eight groups, null if they are not."""
        parts = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ":"))
        sides = F.transform(F.split(text, "::"), parts)

        def filled(s: Column) -> Column:
            left, right = F.get(s, F.lit(0)), F.get(s, F.lit(1))
            return F.when((F.size(s) == 2) & (F.size(left) + F.size(right) <= 7), F.concat(left, F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right)), right)).when((F.size(s) == 1) & (F.size(left) == 8), left)

        return F.when(F.contains(text, F.lit(":")), let(sides, filled))

    half = lambda whole, a: F.aggregate(F.slice(whole, a, 4), F.lit(0).cast("long"), lambda s, p: F.shiftleft(s, 16).bitwiseOR(F.conv(p, 16, 10).cast("long")))
    number = lambda whole: F.when(whole.isNotNull() & F.forall(whole, lambda p: p.rlike("^[0-9a-f]{1,4}$")), F.struct(half(whole, 1).alias("hi"), half(whole, 5).alias("lo")))
    return let(let(let(F.lower(F.regexp_replace(host, "%[^%]+$", "")), plain), groups), number)


def _number(block: str) -> int:
    out = 0
    for part in block.split("."):
        out = out * 256 + int(part)
    return out


def _in4(ip: Column, blocks: tuple[tuple[str, int], ...]) -> Column:
    inside = F.lit(False)
    for first, bits in blocks:
        inside = inside | ip.between(_number(first), _number(first) + (1 << (32 - bits)) - 1)
    return inside


def _bits(group_text: str) -> int:
    """128 bits of leading groups, the rest 0."""
    out, groups = 0, group_text.split(":")
    for g in [*groups, *["0"] * (8 - len(groups))]:
        out = out << 16 | int(g, 16)
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _in6(ip: Column, blocks: tuple[tuple[str, int], ...]) -> Column:
    inside = F.lit(False)
    for first, bits in blocks:
        hi, lo = _bits(first) >> 64, _bits(first) & ((1 << 64) - 1)
        if bits <= 64:
            same = F.shiftrightunsigned(ip["hi"], 64 - bits) == _signed(hi >> (64 - bits)) if bits < 64 else ip["hi"] == _signed(hi)
        else:
            same = (ip["hi"] == _signed(hi)) & ((F.shiftrightunsigned(ip["lo"], 128 - bits) == _signed(lo >> (128 - bits))) if bits < 128 else (ip["lo"] == _signed(lo)))
        inside = inside | same
    return inside


def _kind(blocks: dict, inside, except_) -> Column:
    out = None
    for kind, held in blocks.items():
        yes = inside(held) & ~except_ if kind == "private" else inside(held)
        out = F.when(yes, kind) if out is None else out.when(yes, kind)
    return out.otherwise("public")


def kind4(ip: Column) -> Column:
    """Of an IPv4 number: link_local, multicast, unspecified, loopback, private, reserved or public; null for null."""
    return let(ip, lambda a: F.when(a.isNotNull(), _kind(BLOCKS, lambda b: _in4(a, b), _in4(a, GLOBAL_WITHIN))))


def kind6(ip: Column) -> Column:
    """The same of an IPv6 address as such."""
    return F.when(ip.isNotNull(), _kind(BLOCKS6, lambda b: _in6(ip, b), _in6(ip, GLOBAL_WITHIN6)))


def held(ip: Column) -> Column:
    """array<long>: the IPv4 addresses that an IPv6 one stands for: mapped, 6to4, both ends of Teredo, NAT64, or plainly its last 32 bits."""
    low = F.lit(0xFFFFFFFF).cast("long")
    mapped = F.when((ip["hi"] == 0) & (F.shiftrightunsigned(ip["lo"], 32) == 0xFFFF), ip["lo"].bitwiseAND(low))
    six = F.when(_in6(ip, (("2002", 16),)), F.shiftrightunsigned(ip["hi"], 16).bitwiseAND(low))
    teredo = _in6(ip, (("2001:0", 32),))
    server, client = F.when(teredo, ip["hi"].bitwiseAND(low)), F.when(teredo, F.bitwise_not(ip["lo"]).bitwiseAND(low))
    nat = F.when(_in6(ip, (("64:ff9b", 96),)), ip["lo"].bitwiseAND(low))
    found = F.array_compact(F.array(mapped, six, server, client, nat))
    plain = (ip["hi"] == 0) & (ip["lo"] > 1) & (ip["lo"] <= low)
    return F.when((F.size(found) == 0) & plain, F.array(ip["lo"])).otherwise(found)


def blocked(kind: Column, allow_private: bool = False) -> Column:
    """Whether an address of a kind must not be fetched from; some never, local ones unless allowed."""
    return kind.isin(*NEVER, *(() if allow_private else LOCAL))


def kinds(host: Column) -> Column:
    """array<string>: the kinds of the addresses that a literal host stands for; null for names."""
    of6 = lambda six: F.when(six.isNotNull(), let(held(six), lambda inner: F.when(F.size(inner) > 0, F.transform(inner, kind4)).otherwise(F.array(kind6(six)))))
    of4 = lambda four: F.when(four.isNotNull(), F.array(kind4(four))).otherwise(let(ipv6(host), of6))
    return let(ipv4(host), of4)


def blocked_kind(host: Column, allow_private: bool = False) -> Column:
    """The kind for which a literal host must not be fetched from, null where it may be: kinds that never may come first."""
    first = lambda found, names: F.get(F.filter(found, lambda k: k.isin(*names)), F.lit(0))
    return let(kinds(host), lambda found: first(found, NEVER) if allow_private else F.coalesce(first(found, NEVER), first(found, LOCAL)))


def is_local(host: Column) -> Column:
    """Whether a literal host is on this machine or a private network, whatever it is wrapped in."""
    return F.coalesce(F.exists(kinds(host), lambda k: k.isin("loopback", "private", "link_local", "unspecified", "reserved")), F.lit(False))
