"""Checks and readings of single values as native columns: boxes, zooms, colours, hosts, server entries, short forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespan.functions import addresses
from tilespan.schemas import MAX_ZOOM

#: Short forms of styles and output formats, and hosts that are this machine.
STYLES = {"r": "roadmap", "s": "satellite", "h": "hybrid", "t": "terrain", "m": "map", "y": "hybrid"}
FORMATS = {"p": "png", "j": "jpg", "b": "both", "t": "tiles_only", "i": "image_only"}
LOCAL_NAMES = ("localhost", "localhost.localdomain")
DEFAULT_SERVERS = "mts0,mts1,mts2,mts3"


def _number(value: Column) -> Column:
    """A finite number of a text, null otherwise; true and false are none."""
    n = F.trim(value).try_cast("double")
    return F.when(F.abs(n) < float("inf"), n)


def bbox_error(north: Column, south: Column, east: Column, west: Column, unwrapped: bool = False) -> Column:
    """Why four numbers are no box, by the first rule that they break; null: they are one. unwrapped: east may go on to 360."""
    most = 360.0 if unwrapped else 180.0
    whole = [F.coalesce(F.abs(c) < float("inf"), F.lit(False)) for c in (north, south, east, west)]
    return (
        F.when(~(whole[0] & whole[1] & whole[2] & whole[3]), "not_a_number")
        .when(north <= south, "north_not_above_south")
        .when(~south.between(-90, 90), "south_out_of_range")
        .when(~north.between(-90, 90), "north_out_of_range")
        .when(~west.between(-180, 180), "west_out_of_range")
        .when(~east.between(-180, most), "east_out_of_range")
        .when(east <= west, "east_not_beyond_west")
        .when(east - west > 360, "too_wide")
    )


def unwrapped_east(east: Column, west: Column) -> Column:
    """East of a box that may cross the antimeridian, as a number beyond west."""
    return F.when(east < west, east + 360.0).otherwise(east)


def usable_zooms(low: Column, high: Column) -> Column:
    """struct<low, high> of two texts; null unless both are whole, in range and in order."""
    a, b = (F.when((_number(c) == F.floor(_number(c))) & _number(c).between(0, MAX_ZOOM), _number(c).cast("int")) for c in (low, high))
    return F.when(a <= b, F.struct(a.alias("low"), b.alias("high")))


def max_zoom_choice(value: Column) -> Column:
    """auto, a zoom, null for no choice, or invalid; neither case nor spaces are forgiven."""
    n = value.try_cast("double")
    return F.when(value.isNull() | (value == ""), F.lit(None).cast("string")).when(value == "auto", "auto").when((n == F.floor(n)) & n.between(0, MAX_ZOOM), n.cast("int").cast("string")).otherwise("invalid")


def switch(value: Column) -> Column:
    """true, false, or null for no choice; anything else is invalid."""
    v = F.lower(F.trim(value))
    return F.when(value.isNull() | (v == ""), F.lit(None).cast("string")).when(v.isin("true", "1", "yes", "on"), "true").when(v.isin("false", "0", "no", "off"), "false").otherwise("invalid")


def is_colour(value: Column) -> Column:
    """#RGB, #RGBA, #RRGGBB or #RRGGBBAA."""
    return F.coalesce(F.trim(value).rlike("^#[0-9A-Fa-f]+$") & F.length(F.trim(value)).isin(4, 5, 7, 9), F.lit(False))


def tint_error(breaks: Column, colours: Column) -> Column:
    """Why breaks and colours (comma-separated) are no scheme; null: they are one, or both are empty."""
    listed = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    raw, shades = listed(breaks), listed(colours)
    at = F.transform(raw, _number)
    rising = F.forall(F.zip_with(F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: a < b), lambda x: x)
    return (
        F.when((F.size(raw) == 0) & (F.size(shades) == 0), F.lit(None).cast("string"))
        .when((F.size(raw) == 0) | (F.size(shades) == 0), "only_one")
        .when(F.exists(at, lambda x: x.isNull()), "not_a_number")
        .when(F.exists(shades, lambda c: ~is_colour(c)), "not_a_colour")
        .when(~rising, "not_rising")
        .when(F.size(shades) != F.size(raw) + 1, "wrong_count")
    )


def _mapped(value: Column, words: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in words.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def style_name(short: Column) -> Column:
    return _mapped(F.lower(F.trim(short)), STYLES)


def format_name(short: Column) -> Column:
    return _mapped(F.lower(F.trim(short)), FORMATS)


def style_code(style: Column) -> Column:
    """The one-letter code of a style by name or code; unknown: m."""
    v = F.lower(F.trim(style))
    return F.coalesce(F.when(v.isin(*STYLES), v), _mapped(v, {"roadmap": "r", "satellite": "s", "hybrid": "y", "terrain": "t"}), F.lit("m"))


def first_text(*values: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", F.trim(v)) for v in values))


def bypasses_proxy(host: Column) -> Column:
    """Whether a host is this machine or on a private network."""
    return F.coalesce(F.lower(host).isin(*LOCAL_NAMES), F.lit(False)) | addresses.is_local(host)


def url_error(url: Column, allow_private: bool = False) -> Column:
    """Why a URL must not be fetched, as far as its text tells; null: its host's addresses are to be asked.

    Literal hosts are judged here, IPv6 ones by the IPv4 addresses they hold; allow_private lets local networks through.
    """
    let = addresses.let

    def verdict(raw: Column, place: Column, at: Column, boxed: Column, host: Column) -> Column:
        scheme = F.lower(F.regexp_extract(raw, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        port = F.when(boxed, F.regexp_extract(at, r"\]:(.*)$", 1)).otherwise(F.regexp_extract(at, "^[^:]*:(.*)$", 1))
        whole = ~boxed & ~F.contains(at, F.lit("[")) & ~F.contains(at, F.lit("]")) | boxed & at.rlike(r"^\[[^\[\]]*\](:[^\[\]]*)?$") & addresses.ipv6(host).isNotNull()
        number = lambda p: (p != "") & ~F.coalesce(p.rlike("^[0-9]+$") & p.try_cast("int").between(0, 65535), F.lit(False))
        return (
            F.when(raw.isNull() | (raw == ""), "empty")
            .when(~whole, "no_url")
            .when(~scheme.isin("http", "https"), "scheme")
            .when(let(port, number), "port")
            .when(host == "", "no_host")
            .when(F.contains(place, F.lit("@")), "user_info")
            .when(addresses.blocked_kind(host, allow_private).isNotNull(), "blocked_address")
        )

    def of_host(raw: Column, place: Column, at: Column, boxed: Column) -> Column:
        host = F.lower(F.when(boxed, F.regexp_extract(at, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(at, ":.*$", "")))
        return let(host, lambda h: verdict(raw, place, at, boxed, h))

    of_place = lambda raw, place: let(F.regexp_replace(place, "^.*@", ""), lambda at: of_host(raw, place, at, at.startswith("[")))
    return let(F.trim(url), lambda raw: let(F.regexp_extract(raw, "^[^:/?#]+://([^/?#]*)", 1), lambda place: of_place(raw, place)))


def fetched(url: Column) -> Column:
    """A URL as it is sent: without spaces around and without its fragment."""
    return F.regexp_replace(F.trim(url), "#.*$", "")


def server_error(entry: Column) -> Column:
    """Why an entry is no tile server: a host name, or a URL template with z, x and y and no other placeholders but s and credential."""
    e = F.trim(F.coalesce(entry, F.lit("")))
    web = e.startswith("http://") | e.startswith("https://")
    held = F.regexp_extract_all(e, F.lit(r"(\{[^{}]*\})"), F.lit(1))
    return (
        F.when(e == "", "empty")
        .when(web & (F.regexp_extract(e, "^https?://([^/?#]*)", 1) == ""), "no_host")
        .when(web & (F.size(F.array_except(F.array(F.lit("{z}"), F.lit("{x}"), F.lit("{y}")), held)) > 0), "missing_placeholders")
        .when(web & (F.size(F.array_except(held, F.array(*map(F.lit, ("{z}", "{x}", "{y}", "{s}", "{credential}"))))) > 0), "unknown_placeholders")
        .when(~web & F.contains(e, F.lit("://")), "scheme")
        .when(~web & ~e.rlike(r"^[A-Za-z0-9][A-Za-z0-9.-]*$"), "unknown_host")
    )


def server_list(value: Column) -> Column:
    """The entries of a comma-separated list; none: the default servers."""
    found = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(found) > 0, found).otherwise(F.split(F.lit(DEFAULT_SERVERS), ","))


def server_template(entry: Column, style: Column) -> Column:
    """An entry as a URL template; bare names are hosts of one provider."""
    host = F.when(F.contains(entry, F.lit(".")), entry).otherwise(F.concat(entry, F.lit(".googleapis.com")))
    return F.when(F.contains(entry, F.lit("://")), entry).otherwise(F.concat(F.lit("https://"), host, F.lit("/vt?lyrs="), style, F.lit("&x={x}&y={y}&z={z}")))


def shown(key: Column, value: Column, secret_keys: tuple[str, ...], mark: str) -> Column:
    """A configuration value as it may be shown: a mark in place of secrets that are set."""
    return F.when(key.isin(*secret_keys) & (value != ""), mark).otherwise(value)
