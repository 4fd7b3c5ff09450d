"""Redaction, log lines, URL templates and fingerprints as native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that make a key secret, words that make the name of a query value secret, whole such names, headers, authentication schemes.
SECRET_WORDS = ("password", "passwd", "token", "key", "secret", "authorization", "signature", "credential")
QUERY_WORDS = ("token", "key", "secret", "signature", "password", "passwd", "credential", "auth")
QUERY_NAMES = ("tk", "sig")
SECRET_HEADERS = ("authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "x-auth-token", "x-amz-security-token")
SCHEMES = ("bearer", "basic", "token")

_ANY = lambda words: "(?:" + "|".join(words) + ")"
#: What a query value ends before, what may follow it in prose, and a value in quotes or up to the next separator.
_STOP, _MARKS = r"&#\s\"'<>()\[\]{}", ".,;:!?"
_VALUE = r"""(?:"[^"]*"|'[^']*'|[^\s"',;&(){}\[\]]+)"""
#: (pattern, replacement) of URLs, then of other texts, in order. They need no look-around, so that SQL engines can run them.
URL_RULES = (
    (r"(?i)([a-z][a-z0-9+.-]*://)[^/?#\s@\"'<>]+@", "$1***:***@"),
    (rf"(?i)([?&](?:{'|'.join(QUERY_NAMES)}|[^=&#?\s]*{_ANY(QUERY_WORDS)}[^=&#?\s]*)=)[^{_STOP}]*[^{_STOP}{_MARKS}]", "$1***"),
    (rf"(?i)([?&](?:{'|'.join(QUERY_NAMES)}|[^=&#?\s]*{_ANY(QUERY_WORDS)}[^=&#?\s]*)=)([&#]|$)", "$1***$2"),
)
TEXT_RULES = (
    (rf"(?i)({_ANY(SECRET_HEADERS)}[\"']?[ \t]*:[ \t]*)[^\r\n,;{{}}]+", "$1***"),
    (rf"(?i)(\b{_ANY(SCHEMES)}[ \t]+)[^\s,;:=\"'(){{}}\[\]]{{4,}}", "$1***"),
    (rf"(?i)([\w-]*{_ANY(SECRET_WORDS)}[\"']?[ \t]*[=:][ \t]*){_VALUE}", "$1***"),
)


def _ruled(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for pattern, instead in rules:
        text = F.regexp_replace(text, pattern, instead)
    return text


def mask_url(text: Column) -> Column:
    """User info and secret query values of every URL in a text as ***; the rest, marks after a URL included, stays."""
    return _ruled(text, URL_RULES)


def redact(text: Column, home: str | None = None) -> Column:
    """Masks secrets in URLs, headers, authentication schemes, and what is assigned to secret keys; home: a folder that becomes ~."""
    out = _ruled(_ruled(text, URL_RULES), TEXT_RULES)
    if home and len(home) >= 4:
        for form in dict.fromkeys((home, home.replace("\\", "/"), home.replace("/", "\\"))):
            out = F.replace(out, F.lit(form), F.lit("~"))
    return out


def log_field(value: Column) -> Column:
    """A value for a log line, in quotes if it holds white space, quotes or an equals sign, or is empty."""
    plain = value.rlike(r"^[^\s\"=]+$")
    return F.when(plain, value).otherwise(F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"')))


def log_entries(lines: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Log lines folded into entries: time, level, message; a line that begins none goes on with the last.

    Entries are numbered by a running count, then gathered; an entry's lines are its only group.
    """
    # A line begins an entry if its first two words are a date and a time, and its third is a level in capitals.
    words = F.split(line, r"\s+", 4)
    when = F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1)))
    level = F.get(words, F.lit(2))
    head = F.coalesce((F.length(when) >= 19) & (F.substring(when, 5, 1) == "-") & F.replace(when, F.lit(","), F.lit(".")).try_cast("timestamp").isNotNull() & (level == F.upper(level)) & (level != F.lower(level)), F.lit(False))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("_head", head).withColumn("entry", F.sum(F.col("_head").cast("int")).over(w))
    said = F.when(F.col("_head"), F.coalesce(F.get(words, F.lit(3)), F.lit(""))).otherwise(F.col(line))
    folded = numbered.where("entry > 0").groupBy(key, "entry").agg(F.max(F.when(F.col("_head"), when)).alias("time"), F.max(F.when(F.col("_head"), level)).alias("level"), F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), said.alias("m")))).alias("parts"))
    return folded.select(key, "entry", "time", "level", F.array_join(F.transform("parts", lambda p: p.m), "\n").alias("message"))


def tile_template(url: Column) -> Column:
    """A tile URL with its last three whole-number path segments as {z}/{x}/{y}, null where it has none."""
    pattern = r"/(\d{1,2})/(\d+)/(\d+)(\.[A-Za-z0-9]+)?($|[?#])"
    return F.when(url.rlike(pattern), F.regexp_replace(url, pattern, "/{z}/{x}/{y}$4$5"))


def fingerprint(record: Column) -> Column:
    """The first eight hex digits of the SHA-256 of a struct as JSON; its fields must be in alphabetical order."""
    return F.substring(F.sha2(F.to_json(record), 256), 1, 8)


def is_namespace(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z0-9_]+-[0-9a-f]{8}$")


def human_bytes(n: Column) -> Column:
    """A size in B, KiB, MiB or GiB."""
    return F.when(n < 1 << 10, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KiB", n / (1 << 10))).when(n < 1 << 30, F.format_string("%.1f MiB", n / (1 << 20))).otherwise(F.format_string("%.1f GiB", n / (1 << 30)))


def tile_url(template: Column, zoom: Column, x: Column, y: Column, hosts: list[str], index: Column) -> Column:
    """A template with its placeholders filled; {s} is dealt from hosts by index."""
    host = F.element_at(F.array(*map(F.lit, hosts)), (F.pmod(index, F.lit(len(hosts))) + 1).cast("int"))
    out = F.replace(template, F.lit("{z}"), zoom.cast("string"))
    out = F.replace(out, F.lit("{x}"), x.cast("string"))
    return F.replace(F.replace(out, F.lit("{y}"), y.cast("string")), F.lit("{s}"), host)


#: Characters that no file name may hold.
FORBIDDEN = '\\/:*?"<>|' + "".join(map(chr, range(32)))


def safe_name(name: Column, default: str = "task") -> Column:
    """A name that cannot leave its folder: runs of forbidden characters and ".." become "_", ends are bare of dots, spaces and "_"."""
    marked = F.translate(name, FORBIDDEN, "\x01" * len(FORBIDDEN))
    out = F.replace(F.regexp_replace(marked, "\x01+", "_"), F.lit(".."), F.lit("_"))
    out = F.btrim(out, F.lit(" ._"))
    return F.when(out == "", default).otherwise(F.coalesce(out, F.lit(default)))
