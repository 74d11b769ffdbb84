"""What the assistant functions compute without a model: query parsing, matching, briefs, vetting, nudges, tags."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.scalars import brand_safety, bucket_score, duration_bounds, merged_provenance, normalised, utf16_prefix
from tallyloom.operators.integrity import known_terms

#: Phrases that stand for terms (phrase, facet, term, confidence).
SYNONYMS = (
    ("golden hour", "light", "warm_light", 0.82), ("warm light", "light", "warm_light", 0.95), ("morning light", "light", "daylight", 0.58),
    ("natural light", "light", "daylight", 0.72), ("low light", "light", "low_light", 0.95), ("dark", "light", "low_light", 0.6), ("moody", "vibe", "moody", 0.9),
    ("spa lobby", "room", "reception", 0.7), ("front desk", "room", "reception", 0.74), ("waiting area", "room", "lounge", 0.62), ("steam room", "room", "wet_room", 0.66),
    ("shower", "room", "wet_room", 0.6), ("entrance", "room", "exterior", 0.6), ("arrival", "room", "exterior", 0.55), ("outside", "room", "exterior", 0.62),
    ("treatment room", "room", "treatment_room", 0.95), ("wet room", "room", "wet_room", 0.95), ("close up", "shot_type", "closeup", 0.9), ("detail", "shot_type", "macro", 0.58),
    ("flatlay", "shot_type", "overhead", 0.8), ("flat lay", "shot_type", "overhead", 0.8), ("top down", "shot_type", "overhead", 0.76), ("establishing", "shot_type", "wide", 0.7),
    ("oil pour", "subject", "oil", 0.85), ("massage", "subject", "hands", 0.5), ("staff", "subject", "therapist", 0.7), ("guest", "subject", "client", 0.7),
    ("greenery", "subject", "plants", 0.85), ("vertical", "orientation", "vertical", 0.98), ("portrait", "orientation", "vertical", 0.8),
    ("horizontal", "orientation", "horizontal", 0.98), ("landscape", "orientation", "horizontal", 0.8),
)
#: Words that say nothing.
STOPWORDS = "a an and at by for from in into of on or the to with some any show me find need want clip clips shot shots footage video".split()
#: How many terms of a facet a query keeps, and how sure a term of the vocabulary or a branch is.
FACET_CAPS = {"subject": 6, "shot_type": 4, "room": 4, "light": 3, "vibe": 3, "orientation": 1, "branch": 1}
TERM_CONFIDENCE, BRANCH_CONFIDENCE = 0.95, 0.9
MAPPINGS, UNMAPPED, BOOSTS = 12, 8, 6
#: Tiers that a creator's reliability allows.
TIERS = {"trusted": ("half_day", "full_day", "vip_full"), "proven": ("half_day", "full_day")}
BRIEF_ITEMS = 24

_MAPPING = "array<struct<raw:string,facet:string,term:string,confidence:double>>"


def phrase_table(taxonomy: dict[str, str], branches: tuple[str, ...] = ()) -> list[tuple[str, str, str, float]]:
    """Phrases in the order in which they are looked for: synonyms, terms, branches, each with the longest first."""
    longest = lambda rows: sorted(rows, key=lambda r: -len(r[0]))
    terms = [(term.replace("_", " "), facet, term, TERM_CONFIDENCE) for term, facet in taxonomy.items()]
    places = [(b.removeprefix("branch-").replace("-", " "), "branch", b, BRANCH_CONFIDENCE) for b in branches]
    return [*longest(SYNONYMS), *longest(terms), *places]


def parse_queries(df: DataFrame, taxonomy: dict[str, str], branches: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """``df`` with ``mappings``, ``unmapped``, ``filters`` by facet, ``duration`` and ``boost_terms`` of its queries.

    A phrase that is found is taken out of the text, so a shorter one inside it isn't found
    again.  One fold over the phrases, in the JVM.
    """
    rows = phrase_table(taxonomy, branches)
    phrases = F.array(*[F.struct(F.lit(p).alias("raw"), F.lit(f).alias("facet"), F.lit(t).alias("term"), F.lit(float(c)).alias("confidence")) for p, f, t, c in rows])
    start = F.struct(F.concat(F.lit(" "), normalised(text), F.lit(" ")).alias("rest"), F.array().cast(_MAPPING).alias("found"))

    def take(state: Column, phrase: Column) -> Column:
        at = F.instr(state["rest"], F.concat(F.lit(" "), phrase["raw"], F.lit(" ")))
        # one branch at most
        there = (at > 0) & ~((phrase["facet"] == "branch") & F.exists(state["found"], lambda m: m["facet"] == "branch"))
        cut = F.concat(F.substring(state["rest"], F.lit(1), at), F.substr(state["rest"], at + F.length(phrase["raw"]) + 1, F.length(state["rest"])))
        return F.struct(F.when(there, cut).otherwise(state["rest"]).alias("rest"), F.when(there, F.array_append(state["found"], phrase)).otherwise(state["found"]).alias("found"))

    parsed = df.withColumn("_parse", F.aggregate(phrases, start, take)).withColumn("_duration", duration_bounds(F.col("_parse.rest")))
    spoken = r"(?:under|less than|shorter than|over|longer than|at least)\s+\d{1,4}\s*(?:seconds|second|secs|sec|s)?\b"
    words = F.filter(F.split(F.regexp_replace("_parse.rest", spoken, " "), r"\s+"), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS) & ~w.rlike(r"^\d+$"))
    of = lambda facet: F.array_distinct(F.transform(F.filter("_parse.found", lambda m: m["facet"] == facet), lambda m: m["term"]))
    filters = F.struct(*[F.slice(of(f), 1, n).alias(f) for f, n in FACET_CAPS.items()])
    boosts = F.slice(F.array_distinct(F.concat(*[F.slice(of(f), 1, FACET_CAPS[f]) for f in ("subject", "shot_type", "room", "light", "vibe")])), 1, BOOSTS)
    bounds = F.array_compact(
        F.array(*[F.when(F.col(f"_duration.{side}_s").isNotNull(), F.struct(F.lit(side).alias("raw"), F.lit("duration").alias("facet"), F.concat(F.lit(f"{side} "), F.col(f"_duration.{side}_s").cast("string"), F.lit("s")).alias("term"), F.lit(0.9).alias("confidence"))) for side in ("max", "min")])
    )
    return parsed.select(
        *df.columns,
        F.slice(F.concat("_parse.found", bounds), 1, MAPPINGS).alias("mappings"),
        F.slice(F.array_distinct(words), 1, UNMAPPED).alias("unmapped"),
        filters.alias("filters"),
        F.col("_duration").alias("duration"),
        boosts.alias("boost_terms"),
    ).drop("_parse", "_duration")


def parse_merged(floor: DataFrame, model: DataFrame, least: float = 0.55) -> DataFrame:
    """Mapped words of the lookup, and of the model those for words that the lookup left unmapped.

    ``floor`` (query_id, position, raw, term, kind), ``model`` (query_id, raw, term, kind, confidence).
    """
    open_words = floor.filter("term IS NULL").select("query_id", "raw")
    known = floor.filter("term IS NOT NULL").select("query_id", "raw", "term", "kind")
    wanted = model.filter(F.col("confidence") >= least).join(open_words, ["query_id", "raw"], "left_semi").join(known.select("query_id", "term"), ["query_id", "term"], "left_anti")
    return known.withColumn("source", F.lit("lookup")).unionByName(wanted.select("query_id", "raw", "term", "kind", F.lit("model").alias("source")))


def matched_and_rest(matches: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matches (asset_id, item_id, ...) to known candidates (item_id), and the candidates that nothing matches."""
    kept = matches.join(candidates.select("item_id"), "item_id", "left_semi")
    covering = kept.filter(F.col("verdict") != "no").select("item_id").distinct()
    return kept, candidates.join(covering, "item_id", "left_anti")


def brief(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """A brief's items (brief_id, position, gap_index, ...), numbered anew, cut, and linked to the gap at their index."""
    placed = items.withColumn("seq", F.row_number().over(Window.partitionBy("brief_id").orderBy("position"))).filter(F.col("seq") <= BRIEF_ITEMS)
    return placed.join(gaps.select("brief_id", "gap_index", F.col("gap_id").alias("origin_gap_id")), ["brief_id", "gap_index"], "left")


def allowed_tiers(reliability: Column) -> Column:
    lists = [F.when(reliability == k, F.array(*[F.lit(t) for t in v])) for k, v in TIERS.items()]
    return F.coalesce(*lists, F.array(F.lit("half_day")))


def checked_vet(df: DataFrame) -> DataFrame:
    """Vetting output (score, band, reasons, risk_flags, suggested_tier, reliability) after its checks, with ``notes``.

    An extreme score on fewer than two cited reasons is none; flags without a quote and tiers
    that reliability doesn't allow go.
    """
    cited = F.size(F.filter("reasons", lambda r: r["cited_field"] != "none"))
    thin = F.coalesce((F.col("score") >= 95) | (F.col("score") <= 5), F.lit(False)) & (cited < 2)
    band = F.when(thin, "insufficient_evidence").otherwise(F.col("band"))
    loose = ~thin & (F.col("band") == "insufficient_evidence") & F.col("score").isNotNull()
    quoted = F.filter("risk_flags", lambda f: F.coalesce(F.trim(f["evidence_quote"]) != "", F.lit(False)))
    outside = F.col("suggested_tier").isNotNull() & ~F.array_contains(allowed_tiers(F.col("reliability")), F.col("suggested_tier"))
    notes = {"boundary_score_thin_evidence": thin, "score_without_band": loose, "unevidenced_risk_flag_dropped": F.size(quoted) < F.size("risk_flags"), "tier_outside_band": outside}
    return df.select(
        *[c for c in df.columns if c not in ("score", "band", "risk_flags", "suggested_tier")],
        F.when(~(thin | loose), F.col("score")).alias("score"),
        band.alias("band"),
        quoted.alias("risk_flags"),
        F.when(~outside, F.col("suggested_tier")).alias("suggested_tier"),
        F.array_compact(F.array(*[F.when(holds, code) for code, holds in notes.items()])).alias("notes"),
    )


def filled(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{{name}}`` slots filled; an unknown slot is an error, null says so in words."""
    parts: list[Column] = []
    at = 0
    for slot in re.finditer(r"\{\{(\w+)\}\}", template):
        if slot[1] not in values:
            raise ValueError(f"the template needs {slot[1]}")
        parts += [F.lit(template[at : slot.start()]), F.coalesce(values[slot[1]].cast("string"), F.lit("not provided"))]
        at = slot.end()
    return F.concat(*parts, F.lit(template[at:]))


def tagged(runs: DataFrame, taxonomy: Column) -> tuple[DataFrame, DataFrame]:
    """Of vision runs (asset_id, run_id, provider, description, tags, light_quality, framing, review_flags): assets' fields, and tag rows."""
    fields = runs.select(
        "asset_id",
        F.col("description").alias("ai_description"),
        bucket_score("light_quality").alias("ai_quality_score"),
        bucket_score("framing").alias("ai_framing_score"),
        brand_safety("review_flags").alias("ai_brand_safety"),
        F.col("provider").alias("ai_provenance"),
        known_terms(F.transform("tags", lambda t: t["term"]), taxonomy).alias("ai_terms"),
    )
    tags = runs.select("asset_id", F.col("run_id").alias("ai_run_id"), F.explode("tags").alias("t")).filter(F.array_contains(taxonomy, F.col("t.term")))
    rows = tags.select("asset_id", F.col("t.term").alias("term"), F.lit("ai").alias("source"), F.col("t.confidence").alias("confidence"), "ai_run_id", F.lit(None).cast("long").alias("removed_at"), F.lit(False).alias("rejected_by_human"))
    return fields, rows


def provenance_of(runs: DataFrame) -> DataFrame:
    """(asset_id, ai_provenance): none, the one provider, or mixed."""
    return runs.groupBy("asset_id").agg(merged_provenance("provider").alias("ai_provenance"))


def failing_first(calls: DataFrame, n: int) -> DataFrame:
    """Calls (subject_id, seq) with ``fails``: the first ``n`` of each subject do."""
    return calls.withColumn("fails", F.row_number().over(Window.partitionBy("subject_id").orderBy("seq")) <= n)


def replayed(requests: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Requests with the recorded answer of their cache key, and whether there is one."""
    known = fixtures.dropDuplicates(["cache_key"]).select("cache_key", "output", F.lit(True).alias("_hit"))
    return requests.join(known, "cache_key", "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_hit")


def supported_fields() -> Column:
    """The fields of a vetting that may be cited: those that the request did fill; earlier collabs always, as none is evidence too."""
    there = lambda name: F.coalesce(F.length(F.trim(name)) > 0, F.lit(False))
    known = {
        "display_name": there("display_name"), "primary_handle": there("primary_handle"), "platforms": F.coalesce(F.size("platforms") > 0, F.lit(False)),
        "follower_count": F.coalesce(F.exists("platforms", lambda p: p["followers"].isNotNull()), F.lit(False)), "prior_collabs": F.lit(True),
        "scorecard": there("scorecard_summary"), "application_note": there("application_note"),
    }
    return F.array_compact(F.array(*[F.when(holds, name) for name, holds in known.items()]))


def vetted(df: DataFrame) -> DataFrame:
    """``df`` with its ``reasons`` (claim, cited_field, direction) and ``risk_flags`` (code, quote_source, severity) as they may be shown.

    Six reasons and five flags at most.  What cites a field that wasn't filled cites ``none``; a flag's quote is
    cut from the request itself, or is what was injected into it.
    """
    fields = supported_fields()
    reasons = F.transform(F.slice("reasons", 1, 6), lambda r: r.withField("cited_field", F.when(F.array_contains(fields, r["cited_field"]), r["cited_field"]).otherwise("none")))
    start = lambda name: utf16_prefix(F.col(name), 300)
    sources = {"application_note": start("application_note"), "scorecard_summary": start("scorecard_summary"), "injection_match": F.col("injected")}

    def flag(f: Column) -> Column:
        quote = F.lit(None).cast("string")
        for name, text in sources.items():
            quote = F.when(f["quote_source"] == name, text).otherwise(quote)
        return F.struct(f["code"].alias("code"), quote.alias("evidence_quote"), f["severity"].alias("severity"))

    return df.withColumns({"reasons": reasons, "risk_flags": F.transform(F.slice("risk_flags", 1, 5), flag)})


def vocabulary_candidates(tokens: Column) -> Column:
    """Words that nobody has mapped, as they were typed: the first twelve different ones, none invented."""
    given = F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")
    return F.transform(F.slice(F.array_distinct(given), 1, 12), lambda t: utf16_prefix(t, 60))


def phrased_cells(cells: DataFrame, authored: DataFrame) -> DataFrame:
    """The first forty cells of each scan (scan_id, seq, cell_signature, facets, signal_summary) with ``title``, ``instruction``, ``rationale`` and ``detail``.

    A signature comes back byte for byte, so that it joins its cell again.  Where nobody has written a title (authored:
    cell_signature, title, instruction, rationale) facets and signals are read back; ``detail`` says of a scan whether all, none, or some of its titles were written.
    """
    first = cells.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy("seq"))).filter(F.col("place") <= 40)
    written = authored.dropDuplicates(["cell_signature"]).select("cell_signature", F.struct("title", "instruction", "rationale").alias("written"))
    told = first.join(written, "cell_signature", "left")
    readable = F.replace(F.replace(F.trim("facets"), F.lit("|"), F.lit(", ")), F.lit("_"), F.lit(" "))
    plain = F.struct(
        utf16_prefix(F.concat(F.lit("Uncovered: "), readable), 60).alias("title"),
        utf16_prefix(F.concat(F.lit("Film one shot covering "), readable, F.lit(", vertical, one steady take.")), 200).alias("instruction"),
        utf16_prefix(F.concat(F.lit("Computed from the supplied signals: "), F.coalesce("signal_summary", F.lit(""))), 200).alias("rationale"),
    )
    said = F.coalesce("written", plain)
    scan = Window.partitionBy("scan_id")  # forty rows
    some, every = F.count("written").over(scan), F.count("*").over(scan)
    detail = F.when(some == every, "authored-fixture-v1").when(some == 0, "synthetic-v1").otherwise("authored-fixture-v1-partial")
    return told.select("scan_id", "seq", "cell_signature", said["title"].alias("title"), said["instruction"].alias("instruction"), said["rationale"].alias("rationale"), F.col("written").isNotNull().alias("authored"), detail.alias("detail"))
