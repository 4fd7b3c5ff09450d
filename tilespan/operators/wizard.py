"""Tile URLs to templates: whole-number slots of paths and query values, the likeliest z, x and y among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespan.schemas import MAX_ZOOM

#: Names that query values of each kind go by, and digits of a number at most.
NAMES = {"z": ("z", "zoom", "level", "tilematrix"), "x": ("x", "col", "tilecol"), "y": ("y", "row", "tilerow")}
DIGITS = 10
#: Fixed value: slots of a URL at most, where nothing but trying all triples is left.
MOST_SLOTS = 48


def _parts(url: Column) -> tuple[Column, Column, Column]:
    """What comes before the path, the path, and the query without its question mark."""
    head = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?", 0)
    rest = F.substr(url, F.length(head) + 1)
    bare = F.substring_index(rest, "#", 1)
    path = F.substring_index(bare, "?", 1)
    return head, path, F.when(F.contains(bare, F.lit("?")), F.substr(bare, F.length(path) + 2)).otherwise("")


def slots(urls: DataFrame, key: str, url: str = "url") -> DataFrame:
    """key, url, place (where a slot's digits begin, from 0), size, kind, ordinal, name, number of every slot."""
    head, path, query = _parts(F.col(url))
    cut = urls.select(key, F.col(url).alias("url"), F.length(head).alias("h"), path.alias("path"), query.alias("query"))

    def listed(text: Column, by: str, first: Column, kind: str) -> Column:
        """Pieces of a text with their places: lengths of those before, and a separator each."""
        pieces = F.split(text, by)
        return F.transform(pieces, lambda p, i: F.struct(F.lit(kind).alias("kind"), i.alias("ordinal"), p.alias("piece"), (first + F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda s, q: s + F.length(q) + 1)).alias("at")))

    both = F.concat(listed(F.col("path"), "/", F.col("h"), "path"), listed(F.col("query"), "&", F.col("h") + F.length("path") + 1, "query"))
    rows = cut.select(key, "url", F.inline(both))
    name = F.when((F.col("kind") == "query") & F.contains("piece", F.lit("=")), F.substring_index("piece", "=", 1)).otherwise("")
    value = F.when(F.col("kind") == "query", F.when(F.contains("piece", F.lit("=")), F.substr("piece", F.length(name) + 2))).otherwise(F.col("piece"))
    digits = F.when(F.col("kind") == "query", F.regexp_extract(value, "^([0-9]+)$", 1)).otherwise(F.regexp_extract(value, r"^([0-9]+)(\.[A-Za-z0-9]+)?$", 1))
    found = rows.withColumn("name", F.lower(name)).withColumn("digits", digits).where(F.length("digits").between(1, DIGITS))
    place = F.col("at") + F.when(F.col("kind") == "query", F.length("name") + 1).otherwise(0)
    return found.select(key, "url", place.cast("int").alias("place"), F.length("digits").alias("size"), "kind", F.col("ordinal").cast("int").alias("ordinal"), "name", F.col("digits").cast("long").alias("number"))


def in_grid(z: Column, x: Column, y: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return z.between(0, MAX_ZOOM) & (x >= 0) & (x < n) & (y >= 0) & (y < n)


def _named(s: Column) -> Column:
    """The first triple of query values that go by the names of z, x and y."""
    by = lambda words: F.filter(s, lambda c: (c.kind == "query") & c["name"].isin(*words))
    of = {r: by(words) for r, words in NAMES.items()}
    triple = lambda z, x, y: F.struct(z.alias("z"), x.alias("x"), y.alias("y"))
    every = F.flatten(F.transform(of["z"], lambda z: F.flatten(F.transform(of["x"], lambda x: F.transform(of["y"], lambda y: triple(z, x, y))))))
    return F.get(F.filter(every, lambda t: in_grid(t.z.number, t.x.number, t.y.number)), F.lit(0))


def _neighbours(s: Column, second: str, third: str) -> Column:
    """The first three path segments in a row that are z, then the other two in the given order."""
    three = lambda i: F.struct(F.get(s, i).alias("z"), F.get(s, i + 1).alias(second), F.get(s, i + 2).alias(third))
    runs = F.when(F.size(s) >= 3, F.transform(F.sequence(F.lit(0), F.size(s) - 3), three))

    def fits(t: Column) -> Column:
        one, two, last = t.z, t[second], t[third]
        return (last.kind == "path") & (one.kind == "path") & (two.kind == "path") & (two.ordinal == one.ordinal + 1) & (last.ordinal == two.ordinal + 1) & in_grid(t.z.number, t.x.number, t.y.number)

    found = F.get(F.filter(runs, fits), F.lit(0))
    return F.when(found.isNotNull(), F.struct(found.z.alias("z"), found.x.alias("x"), found.y.alias("y")))


def templates(urls: DataFrame, key: str, url: str = "url", most: int = MOST_SLOTS) -> DataFrame:
    """key, template, scheme, subdomains of the URLs that have a z, an x and a y inside the grid.

    Named query values come first, then neighbouring path segments in the order z, x, y, then z, y, x: these are found in one
    pass over a URL's slots. Only where there are none are triples of any slots ranked, more names before fewer and earlier places
    before later; a URL of more than `most` slots is then no tile's and has no template.
    """
    of = slots(urls, key, url).groupBy(key, "url").agg(F.array_sort(F.collect_list(F.struct("place", "size", "kind", "ordinal", "name", "number"))).alias("s"))
    sure = of.withColumn("t", F.coalesce(_named(F.col("s")), _neighbours(F.col("s"), "x", "y"), _neighbours(F.col("s"), "y", "x")))
    open_ = sure.where(F.col("t").isNull() & F.size("s").between(3, most)).select(key, "url", "s")
    triples = open_.select("*", F.explode("s").alias("z")).select("*", F.explode("s").alias("x")).select("*", F.explode("s").alias("y"))
    able = triples.where((F.col("z.place") != F.col("x.place")) & (F.col("z.place") != F.col("y.place")) & (F.col("x.place") != F.col("y.place")) & in_grid(F.col("z.number"), F.col("x.number"), F.col("y.number")))
    named = sum(((F.col(f"{r}.kind") == "query") & F.col(f"{r}.name").isin(*words)).cast("int") for r, words in NAMES.items())
    rank = F.struct((-named).alias("b"), F.col("z.place").alias("c"), F.col("x.place").alias("d"), F.col("y.place").alias("e"))
    guessed = able.groupBy(key, "url").agg(F.min_by(F.struct("z", "x", "y"), rank).alias("t"))
    best = sure.where("t is not null").select(key, "url", "t").unionByName(guessed).select(key, "url", "t.z", "t.x", "t.y")
    chosen = F.array_sort(F.array(*(F.struct(F.col(f"{r}.place").alias("place"), F.col(f"{r}.size").alias("size"), F.lit("{" + r + "}").alias("mark")) for r in "zxy")))
    swap = lambda text, c: F.concat(F.substr(text, F.lit(1), c.place), c.mark, F.substr(text, c.place + c.size + 1))
    made = F.aggregate(F.reverse(chosen), F.col("url"), swap)
    head, path, _ = _parts(F.col("url"))
    host = F.regexp_replace(F.regexp_replace(head, "^.*://", ""), "^.*@", "")
    first = F.substring_index(host, ".", 1)
    subdomains = F.when(F.contains(host, F.lit(".")) & first.rlike("^[A-Za-z]$"), F.lit("a,b,c")).when(F.contains(host, F.lit(".")) & first.rlike("^[0-9]$"), F.lit("1,2,3")).otherwise("")
    scheme = F.when(F.array_contains(F.split(F.lower(path), "/"), "tms"), "tms").otherwise("xyz")
    return best.select(key, made.alias("template"), scheme.alias("scheme"), subdomains.alias("subdomains"))
