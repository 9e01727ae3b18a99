"""Places of interest: elements with tags become businesses, contacts and cities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospectra.functions.fixed_values import AMENITIES, BIDI_MARKS, NOT_A_VALUE
from prospectra.functions.text import blank_to_null, strip
from prospectra.operators.windows import keep_first

from .keys import with_ids

ELEMENT = "struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>"


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """Areas by key: name, country, region, tags and bounding box (south, west, north, east)."""
    area = "struct<name: string, country: string, region: string, tags: map<string, string>, bbox: array<double>>"
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, {area}>")).alias("area", "a")).select("area", "a.*")


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """Filters in their order: (``group``, ``pos``, ``category``, ``tags``)."""
    kind = "struct<label: string, filters: array<struct<category: string, tags: map<string, string>>>>"
    text = spark.read.text(path, wholetext=True)
    groups = text.select(F.explode(F.from_json("value", f"map<string, {kind}>")).alias("group", "g"))
    return groups.select("group", F.posexplode("g.filters").alias("pos", "f")).select("group", "pos", "f.*")


def tag(key: str) -> Column:
    """A tag's value; null if missing or empty."""
    return blank_to_null(F.try_element_at("tags", F.lit(key)))


def has_tags(wanted: dict[str, str | None]) -> Column:
    """Every key is there, with its value unless that is ``*`` or null."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & (F.map_contains_key("tags", key) if value in ("*", None) else F.coalesce(F.try_element_at("tags", F.lit(key)) == value, F.lit(False)))
    return out


def with_location(elements: DataFrame) -> DataFrame:
    """Own latitude and longitude if both are there, else the centre's; ``source_id`` is type/id."""
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return elements.withColumns({
        "source_id": F.concat_ws("/", "type", F.col("id").cast("string")),
        "lat": F.when(own, F.col("lat")).otherwise(F.col("center.lat")),
        "lon": F.when(own, F.col("lon")).otherwise(F.col("center.lon")),
    })


def in_box(south: Column | float, west: Column | float, north: Column | float, east: Column | float) -> Column:
    return F.col("lat").between(south, north) & F.col("lon").between(west, east)


#: Levels of cells: at level k a side is 360 / 2^k degrees. The finest is about 40 m.
FINEST = 20


def _level(low: str, high: str) -> Column:
    """The level whose cells are the smallest that are no smaller than the side of an area."""
    side = F.greatest(F.col(high) - F.col(low), F.lit(360.0 / (1 << FINEST)))
    return F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / side))).cast("int")


def in_areas(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Points with each area (``south``, ``west``, ``north``, ``east``) that holds them, a street or a continent.

    The cells of an area have a height and a width of their own, each about its own, so that it spans
    four of them at most. Points meet areas in an equi join on the cells of each size in use, of which
    there are at most (FINEST + 1)^2 and mostly a few; then the box is checked. An area whose
    south is above its north or west beyond its east holds nothing.
    """
    cell = lambda c, level: F.floor((F.col(c).cast("double") + 360) * F.pow(F.lit(2.0), level) / 360).cast("long")
    sized = areas.filter("south <= north AND west <= east").withColumns({"_high": _level("south", "north"), "_wide": _level("west", "east")})
    span = lambda a, b, level: F.explode(F.sequence(cell(a, F.col(level)), cell(b, F.col(level))))
    rows = sized.withColumn("_row", span("south", "north", "_high")).withColumn("_column", span("west", "east", "_wide"))
    sizes = [F.struct(F.lit(r["_high"]).alias("_high"), F.lit(r["_wide"]).alias("_wide")) for r in sized.select("_high", "_wide").distinct().collect()]
    if not sizes:
        sizes = [F.struct(F.lit(0).alias("_high"), F.lit(0).alias("_wide"))]
    met = points.withColumn("_size", F.explode(F.array(*sizes))).select(*points.columns, "_size.*").withColumns({"_row": cell("lat", F.col("_high")), "_column": cell("lon", F.col("_wide"))})
    found = met.join(rows, ["_high", "_wide", "_row", "_column"])
    return found.filter(in_box(F.col("south"), F.col("west"), F.col("north"), F.col("east"))).drop("_high", "_wide", "_row", "_column")


def tiles(south: float, west: float, north: float, east: float, n: int, spark: SparkSession) -> DataFrame:
    """n x n equal tiles of a box."""
    if south >= north or west >= east or n < 1:
        raise ValueError("a box needs its least corner below its greatest, and one tile at least")
    high, wide = (north - south) / n, (east - west) / n
    grid = spark.range(n).withColumnRenamed("id", "row").withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.select(
        "row", "column", (F.lit(south) + F.col("row") * high).alias("south"), (F.lit(west) + F.col("column") * wide).alias("west"),
        (F.lit(south) + (F.col("row") + 1) * high).alias("north"), (F.lit(west) + (F.col("column") + 1) * wide).alias("east"),
    )


def tile_of(south: float, west: float, north: float, east: float, n: int) -> Column:
    """The tile of a row's location, without a join; its far edges belong to the last tile."""
    at = lambda c, low, high: F.least(F.floor((F.col(c) - low) / ((high - low) / n)), F.lit(n - 1).cast("long"))
    return F.when(in_box(south, west, north, east), at("lat", south, north) * n + at("lon", west, east))


def match_category(filters: list[tuple[str, dict[str, str | None]]]) -> Column:
    """The category of the first filter that matches; null at once if that is an ``any_`` filter."""
    out = F.lit(None).cast("string")
    for category, wanted in reversed(filters):
        out = F.when(has_tags(wanted), F.lit(None if category.startswith("any_") else category)).otherwise(out)
    return out


def classify() -> Column:
    """The class of a business from its tags; the order of the rules matters."""
    amenity = tag("amenity")
    return (
        F.when(tag("craft").isNotNull(), "trades")
        .when((tag("office") == "construction_company") | (tag("company") == "construction"), "contractors")
        .when(amenity.isin(AMENITIES["food"]), "food")
        .when(amenity.isin(AMENITIES["health"]) | tag("healthcare").isNotNull(), "health")
        .when(amenity.isin(AMENITIES["education"]), "education")
        .when(amenity.isin(AMENITIES["finance"]), "finance")
        .when(amenity.isin(AMENITIES["religious"]), "religious")
        .when(amenity.isin(AMENITIES["auto"]), "auto")
        .when(tag("shop").isNotNull(), "retail")
        .when(tag("tourism").isNotNull(), "hospitality")
        .when(tag("leisure").isNotNull(), "recreation")
        .when(tag("office").isNotNull(), "professional_services")
        .when(tag("industrial").isNotNull(), "industrial")
        .otherwise("other")
    )


def website() -> Column:
    return F.coalesce(tag("website"), tag("contact:website"), tag("url"))


def address() -> Column:
    parts = F.concat_ws(", ", *[tag(f"addr:{p}") for p in ("housenumber", "street", "city", "postcode", "country")])
    return F.when(F.map_contains_key("tags", "addr:full"), F.try_element_at("tags", F.lit("addr:full"))).otherwise(blank_to_null(parts))


def is_phone_key(key: Column) -> Column:
    k = F.lower(strip(key))
    return k.rlike("^(contact:)?(phone|mobile|telephone|tel|whatsapp)$|^contact:(phone|mobile|telephone|tel|whatsapp)(:|$)|^(phone|mobile|telephone):")


def is_email_key(key: Column) -> Column:
    return F.lower(strip(key)).rlike("^(contact:)?email$|^contact:email:|^email:")


def clean_value(value: Column) -> Column:
    v = strip(F.translate(value, BIDI_MARKS, ""))
    return F.when(~F.lower(v).isin(NOT_A_VALUE), v)


def split_phones(value: Column) -> Column:
    """Phone numbers of a value that may hold several."""
    bare = F.when(F.lower(value).startswith("tel:"), F.substr(value, F.lit(5))).otherwise(value)
    return F.array_compact(F.transform(F.split(bare, r"(?i)\s*/\s*|\s*[,;:\n]\s*|\s+or\s+"), clean_value))


def split_emails(value: Column) -> Column:
    bare = F.when(F.lower(value).startswith("mailto:"), F.substr(value, F.lit(8))).otherwise(value)
    found = F.transform(F.split(bare, r"[,\s;\n]+"), lambda v: F.regexp_replace(F.lower(clean_value(v)), "^[;,]+|[;,]+$", ""))
    return F.filter(found, lambda v: v.isNotNull() & F.contains(v, F.lit("@")))


def contacts(rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct (*keys, ``contact_type``, ``value``) of the tags of each row."""
    pairs = rows.select(*keys, F.explode(F.map_entries("tags")).alias("tag"))
    value = clean_value(F.col("tag.value"))
    phones = F.when(is_phone_key(F.col("tag.key")), split_phones(value))
    emails = F.when(is_email_key(F.col("tag.key")), split_emails(value))
    typed = pairs.select(*keys, F.explode(F.array(F.struct(F.lit("phone").alias("t"), phones.alias("v")), F.struct(F.lit("email").alias("t"), emails.alias("v")))).alias("c"))
    return typed.select(*keys, F.col("c.t").alias("contact_type"), F.explode("c.v").alias("value")).distinct()


def import_elements(elements: DataFrame, filters: list[tuple[str, dict[str, str | None]]] | None = None, source: str = "osm", known: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(businesses, contacts) of the named elements. Of elements with one key the first by content (as JSON) stays.

    Ids are 64-bit hashes of the key below zero, free of collisions with each other and, where
    ``known`` businesses are given, with theirs; elements that these hold already are left out.
    With ``keep``, which writes a table and reads it, elements are read once for ids, businesses and contacts.
    """
    named = with_location(elements.filter(tag("name").isNotNull()))
    category = F.coalesce(match_category(filters), classify()) if filters else classify()
    rows = named.select(
        F.lit(source).alias("source"), "source_id", tag("name").alias("name"),
        category.alias("category"), website().alias("website_url"), address().alias("address"), "lat", "lon", "tags",
    )
    rows = keep_first(rows, ["source", "source_id"], F.to_json(F.struct(*rows.columns)))
    if known is not None and {"source", "source_id"} <= set(known.columns):
        rows = rows.join(known.select("source", "source_id"), ["source", "source_id"], "left_anti")
    rows = with_ids(keep(rows, "imported") if keep else rows, ["source", "source_id"], "business_id", known)
    return rows, contacts(rows, "business_id")


# --- tables that fetchers of other services leave


def registrar_of(rdap: Column) -> Column:
    """The name in the card of the first entity with the registrar's role."""
    entities = F.from_json(rdap, "struct<entities: array<struct<roles: array<string>, vcardArray: string>>>")["entities"]
    card = F.get(F.filter(entities, lambda e: F.array_contains(e["roles"], "registrar")), F.lit(0))["vcardArray"]
    rows = F.from_json(F.get_json_object(card, "$[1]"), "array<string>")
    named = F.get(F.filter(rows, lambda r: F.get_json_object(r, "$[0]") == "fn"), F.lit(0))
    return F.get_json_object(named, "$[3]")


def crawl_summary(domains: DataFrame, lines: DataFrame) -> DataFrame:
    """Whether a crawl knows each domain, how many records it has and its latest time."""
    found = lines.groupBy("domain").agg(F.count(F.lit(1)).alias("record_count"), F.max("timestamp").alias("latest_timestamp"))
    return domains.join(found, "domain", "left").select(*domains.columns, F.col("record_count").isNotNull().alias("has_crawl_data"), F.coalesce("record_count", F.lit(0)).alias("record_count"), "latest_timestamp")


def read_domain_list(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Distinct domains of a CSV's first column."""
    from prospectra.functions.text import normalize_domain

    rows = spark.read.csv(path, header=header)
    return rows.select(normalize_domain(F.col(rows.columns[0])).alias("domain")).filter("domain IS NOT NULL").distinct()


def list_exports(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "modificationTime").orderBy(F.desc("modificationTime"), "name")


def geocode_area(hits: DataFrame) -> DataFrame:
    """Area of a geocoder's hit: its box as numbers and the first of city, town, state and country as its name."""
    box = F.transform("boundingbox", lambda x: x.cast("double"))  # south, north, west, east
    name = F.coalesce(*[F.col("address")[k] for k in ("city", "town", "state", "country")])
    return hits.select(name.alias("name"), F.col("address")["country_code"].alias("country"), box[0].alias("south"), box[2].alias("west"), box[1].alias("north"), box[3].alias("east"))
