"""Scalar functions over columns, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
EARTH_RADIUS_M = 6371008.8
QUICKTIME_EPOCH_S = 2082844800
BUCKET_SCORES = {"good": 0.8, "usable": 0.55, "poor": 0.3}
DAY_MS = 86_400_000


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rate(part: Column | str, whole: Column | str) -> Column:
    """A ratio to three places; null where nothing was counted."""
    return F.round(c(part) / F.nullif(c(whole), F.lit(0)), 3)


def percent(x: Column | str) -> Column:
    return F.when(c(x).isNull(), "unknown").otherwise(F.concat(F.floor(c(x) * 100 + 0.5).cast("string"), F.lit("%")))


def normalised(text: Column | str) -> Column:
    """Lower case; letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c(text)), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def spaced_tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(c(text)), r"\s+"), lambda t: t != "")


def ascii_words(text: Column | str) -> Column:
    return F.filter(F.split(F.lower(c(text)), r"[^a-z0-9_]+"), lambda t: t != "")


def label(slug: Column | str) -> Column:
    return F.replace(c(slug), F.lit("_"), F.lit(" "))


def slug_words(slug: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c(slug)), r"[_\-\s]+", " "))


def cell_signature(facets: Column | str) -> Column:
    """``k=v`` of a map, by key, joined by a bar; ``shot`` counts as ``shot_type``."""
    named = F.transform(F.map_entries(c(facets)), lambda e: F.struct(F.when(e["key"] == "shot", "shot_type").otherwise(e["key"]).alias("key"), e["value"].alias("value")))
    return F.array_join(F.transform(F.array_sort(named), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def instruction(facets: Column | str) -> Column:
    """What to film, from a facet map."""
    at = lambda k: F.try_element_at(c(facets), F.lit(k))
    shot = F.coalesce(label(F.coalesce(at("shot_type"), at("shot"))), F.lit("shot"))
    place = F.when(at("room").isNotNull(), F.concat(F.lit(" of the "), label(at("room")))).otherwise("")
    subject = F.when(at("subject").isNotNull(), F.concat(F.lit(" with "), label(at("subject")))).otherwise("")
    light = F.coalesce(label(at("light")), F.lit("natural light"))
    return F.concat(shot, place, subject, F.lit(", vertical, "), light)


def duration_bounds(text: Column | str) -> Column:
    """Seconds named by ``under N`` and ``over N``, with or without a unit of seconds."""

    def seconds(words: str) -> Column:
        return F.nullif(F.regexp_extract(c(text), rf"(?i)(?:{words})\s+(\d{{1,4}})", 1), F.lit("")).cast("int")

    return F.struct(seconds("over|longer than|at least").alias("min_s"), seconds("under|less than|shorter than").alias("max_s"))


#: What tries to give orders to a reader, in the order in which it is looked for.
INJECTIONS = (
    r"ignore (all )?(previous|prior|above) instructions?",
    r"disregard (the )?(previous|prior|above)",
    r"you (are|must) now",
    r"system prompt",
    r"\bscore\s*[:=]?\s*(100|99|98|97|96|95)\b",
    r"(mark|set|rate)\s+(this|the)\s+creator\s+as",
    r"perfect fit",
)


def injected(text: Column | str) -> Column:
    """The sentence, full stop to full stop, of the first of INJECTIONS that a text has; 300 characters at most, null if none."""

    def sentence(pattern: str) -> Column:
        # sentences are tried from their start only, so a long text is read once
        return F.nullif(F.regexp_extract(c(text), rf"(?i)(?:^|(?<=\.))[^.]*?(?:{pattern})[^.]*\.?", 0), F.lit(""))

    first = F.coalesce(*[sentence(p) for p in INJECTIONS])
    clean = F.regexp_replace(first, r"^\s+|\s+$", "")
    return F.when(c(text).rlike("(?i)" + "|".join(INJECTIONS)), F.substring(clean, 1, 300))


def visit_window(day: Column | str, margin_hours: float) -> Column:
    """Half-open: from the day's start less the margin to the next day's start and the margin (UTC)."""
    start = F.to_timestamp(c(day).cast("date"))
    minutes = int(round(margin_hours * 60))
    return F.struct(
        (start - F.expr(f"INTERVAL {minutes} MINUTE")).alias("from"),
        (start + F.expr(f"INTERVAL {24 * 60 + minutes} MINUTE")).alias("to"),
    )


def iso_seconds(at_ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(c(at_ms)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def quicktime_seconds(x: Column | str) -> Column:
    """Seconds since 1970 of a QuickTime time; zero says nothing."""
    return F.nullif(c(x), F.lit(0)) - QUICKTIME_EPOCH_S


def iso8601(text: Column | str) -> Column:
    """(at_ms, has_offset) of a date, alone or with a time and an offset; null if it isn't one.

    Seconds may be left out, and of a date its day, or day and month; without an offset it is UTC.
    """
    shape = r"^\s*(\d{4})(?:-(\d{2})(?:-(\d{2})(?:[T ](\d{2}):(\d{2})(?::(\d{2}))?(?:\.(\d{1,3})\d*)?\s*(Z|[+-]\d{2}:?\d{2})?)?)?)?\s*$"
    part = lambda i: F.regexp_extract(c(text), shape, i)
    given = lambda i, least: F.when(part(i) == "", least).otherwise(part(i))
    day = F.concat_ws("-", part(1), given(2, "01"), given(3, "01"))
    time = F.concat_ws(":", given(4, "00"), given(5, "00"), given(6, "00"))
    base = F.unix_millis(F.try_to_timestamp(F.concat_ws(" ", day, time), F.lit("yyyy-MM-dd HH:mm:ss")))
    milli = F.rpad(part(7), 3, "0").cast("int")
    zone = F.replace(part(8), F.lit(":"), F.lit(""))
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone.isin("", "Z"), 0).otherwise(sign * (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")))
    found = c(text).rlike(shape)
    return F.when(found & base.isNotNull(), F.struct((base + milli - minutes * 60_000).alias("at_ms"), (part(8) != "").alias("has_offset")))


def iso6709(text: Column | str) -> Column:
    """(lat, lng, alt_m) of a position in degrees, or degrees with minutes, or with seconds too.

    Null off the globe and at 0, 0; degrees to six places, metres to three, null without a height.
    """
    number = r"([+-]\d+(?:\.\d+)?)"
    shape = rf"^\s*{number}{number}{number}?/?\s*$"
    part = lambda i: F.regexp_extract(c(text), shape, i)

    def degrees(token: Column, digits: int) -> Column:
        size = F.length(F.substring_index(token, ".", 1)) - 1
        value = F.abs(token.cast("double"))
        whole = (
            F.when(size <= digits, value)
            .when(size == digits + 2, F.floor(value / 100) + value % 100 / 60)
            .when(size == digits + 4, F.floor(value / 10000) + F.floor(value % 10000 / 100) / 60 + value % 100 / 3600)
        )
        return F.when(token.startswith("-"), -whole).otherwise(whole)

    lat, lng = degrees(part(1), 2), degrees(part(2), 3)
    plausible = (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~((lat == 0) & (lng == 0))
    height = F.round(F.nullif(part(3), F.lit("")).cast("double"), 3)
    return F.when(c(text).rlike(shape) & plausible, F.struct(F.round(lat, 6).alias("lat"), F.round(lng, 6).alias("lng"), height.alias("alt_m")))


def haversine_m(lat1: Column | str, lng1: Column | str, lat2: Column | str, lng2: Column | str) -> Column:
    p, q = F.radians(c(lat1)), F.radians(c(lat2))
    half = lambda x: F.pow(F.sin(x / 2), 2)
    h = half(q - p) + F.cos(p) * F.cos(q) * half(F.radians(c(lng2)) - F.radians(c(lng1)))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def display_size(width: Column, height: Column, rotation: Column, pixel_ratio: Column | None = None) -> Column:
    """Coded size with square pixels, turned upright."""
    wide = F.floor(width * F.coalesce(pixel_ratio, F.lit(1.0)) + 0.5).cast("int") if pixel_ratio is not None else width
    turned = F.pmod(F.coalesce(rotation, F.lit(0)), F.lit(180)) == 90
    return F.struct(F.when(turned, height).otherwise(wide).alias("width"), F.when(turned, wide).otherwise(height).alias("height"))


def rotation_of(a: Column, b: Column, cc: Column, d: Column) -> Column:
    """Degrees from the signs of a display matrix."""
    return (
        F.when((a > 0) & (d > 0), 0)
        .when((b > 0) & (cc < 0), 90)
        .when((a < 0) & (d < 0), 180)
        .when((b < 0) & (cc > 0), 270)
        .otherwise(0)
    )


def orientation(width: Column, height: Column) -> Column:
    return F.when(height > width, "vertical").when(height < width, "horizontal").when(height == width, "square")


def luma(red: Column, green: Column, blue: Column) -> Column:
    return red * 0.299 + green * 0.587 + blue * 0.114


def dhash_hex(grid: Column | str, columns: int = 9, rows: int = 8) -> Column:
    """Difference hash of a row-major luma grid: a bit where the left cell is brighter, as 16 hex digits."""
    bits = F.transform(
        F.sequence(F.lit(0), F.lit((columns - 1) * rows - 1)),
        lambda k: F.when(
            F.get(c(grid), (F.floor(k / (columns - 1)) * columns + k % (columns - 1)).cast("int"))
            > F.get(c(grid), (F.floor(k / (columns - 1)) * columns + k % (columns - 1) + 1).cast("int")),
            "1",
        ).otherwise("0"),
    )
    text = F.array_join(bits, "")
    nibbles = F.transform(F.sequence(F.lit(0), F.lit((columns - 1) * rows // 4 - 1)), lambda k: F.lower(F.conv(F.substr(text, k * 4 + 1, F.lit(4)), 2, 16)))
    return F.array_join(nibbles, "")


def hamming_hex(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two equally long hex texts of up to 16 digits; null if they aren't that."""
    ok = (F.length(c(a)) == F.length(c(b))) & (F.length(c(a)) > 0) & c(a).rlike("^[0-9a-fA-F]{1,16}$") & c(b).rlike("^[0-9a-fA-F]{1,16}$")
    number = lambda x: F.conv(c(x), 16, -10).cast("long")
    return F.when(ok, F.bit_count(number(a).bitwiseXOR(number(b))).cast("int"))


def frame_times(duration_s: Column | str, floor: int, ceiling: int) -> Column:
    """Evenly spaced times, six places, inside a clip; three and one more for each three seconds."""
    n = F.least(F.lit(ceiling), F.greatest(F.lit(floor), F.floor(c(duration_s) / 3 + 0.5).cast("int") + 3))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.round(i * c(duration_s) / (n + 1), 6))


def bucket_score(bucket: Column | str) -> Column:
    return F.coalesce(*[F.when(c(bucket) == k, v) for k, v in BUCKET_SCORES.items()])


def merged_provenance(values: Column | str) -> Column:
    """An aggregate: none, the one provenance, or mixed."""
    named = F.when(c(values) != "none", c(values))
    return F.when(F.count_distinct(named) == 0, "none").when(F.count_distinct(named) == 1, F.min(named)).otherwise("mixed")


def brand_safety(flags: Column | str) -> Column:
    return F.when(F.size(F.coalesce(c(flags), F.array())) > 0, "review").otherwise("clear")


def effective_score(override: Column | str, model: Column | str) -> Column:
    return F.struct(
        F.coalesce(c(override), c(model)).alias("score"),
        F.when(c(override).isNotNull(), "human").when(c(model).isNotNull(), "model").otherwise("none").alias("source"),
    )


def canonical_flat(values: Column | str) -> Column:
    """Canonical JSON of a map of texts to JSON texts: keys in order, no spaces."""
    entries = F.array_sort(F.map_entries(c(values)))
    quoted = lambda k: F.substr(F.to_json(F.struct(k.alias("k"))), F.lit(6), F.length(F.to_json(F.struct(k.alias("k")))) - 6)
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def sha256(text: Column | str) -> Column:
    return F.sha2(c(text), 256)


def cache_key(*hashes: Column) -> Column:
    return F.concat_ws(".", *hashes)


def pick(hash_hex: Column | str, n: int) -> Column:
    """A choice in 0..n-1 from the first eight hex digits."""
    return F.conv(F.substring(c(hash_hex), 1, 8), 16, 10).cast("long") % n


def simulated_latency(hash_hex: Column | str, base: int, spread: int = 400) -> Column:
    return base + F.conv(F.substring(c(hash_hex), 1, 4), 16, 10).cast("long") % (spread + 1)


def uuid7_parts(text: Column | str) -> Column:
    """(at_ms, counter) of a version-7 identifier."""
    bare = F.replace(c(text), F.lit("-"), F.lit(""))
    return F.struct(F.conv(F.substring(bare, 1, 12), 16, 10).cast("long").alias("at_ms"), F.conv(F.substring(bare, 14, 3), 16, 10).cast("int").alias("counter"))


def bytes_text(n: Column | str) -> Column:
    x = c(n).cast("double")
    return (
        F.when(x < 1024, F.concat(x.cast("long").cast("string"), F.lit(" B")))
        .when(x < 1024**2, F.format_string("%.1f KB", x / 1024))
        .when(x < 1024**3, F.format_string("%.1f MB", x / 1024**2))
        .when(x.isNotNull(), F.format_string("%.2f GB", x / 1024**3))
    )


def utf16_length(text: Column | str) -> Column:
    """The length of a text in UTF-16 units, of which characters beyond U+FFFF take two."""
    return F.char_length(c(text)) + F.regexp_count(c(text), F.lit(r"[\x{10000}-\x{10FFFF}]"))


def utf16_prefix(text: Column | str, most: int) -> Column:
    """The longest start of a text of no more than ``most`` UTF-16 units; no character is halved."""
    start = F.substring(c(text), 1, most)
    # at most half of it is too much, and each character in the rest takes one unit or two
    fits = lambda n: utf16_length(F.substr(start, F.lit(1), n)) <= most
    lengths = F.filter(F.sequence(F.greatest(F.char_length(start) - most // 2 - 1, F.lit(0)), F.char_length(start)), fits)
    return F.when(utf16_length(start) <= most, start).otherwise(F.substr(start, F.lit(1), F.array_max(lengths)))


def fitted_body(text: Column | str, most: int = 900) -> Column:
    """A text of paragraphs within ``most`` UTF-16 units: last paragraphs go, down to two, before a sentence is cut."""

    def fitted(parts: Column) -> Column:
        start = lambda k: F.array_join(F.slice(parts, 1, k), "\n\n")
        counts = F.filter(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda k: utf16_length(start(k)) <= most)
        return utf16_prefix(start(F.coalesce(F.array_max(counts), F.lit(2))), most)

    # each paragraph takes two units at least, so no more of them can fit; bound once, not for each count
    parts = F.slice(F.split(c(text), "\n\n"), 1, max(2, most // 2 + 1))
    return F.when(utf16_length(text) <= most, c(text)).otherwise(F.get(F.transform(F.array(parts), fitted), F.lit(0)))
