"""Audits: invariants of tables, provenance of runs, schemas of payloads, post-checks of model output."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
LOW_CONFIDENCE, COVERS_CONFIDENCE, MATCH_FLOOR = 0.55, 0.6, 0.25
ERROR_CAP = 40


def so(condition: Column) -> Column:
    """Two-valued: unknown isn't so."""
    return F.coalesce(condition, F.lit(False))


def invariants(df: DataFrame, broken: dict[str, Column]) -> DataFrame:
    """(id, status, count): how many rows break each invariant, in one pass over ``df``."""
    counts = df.agg(*[F.count_if(so(c)).alias(name) for name, c in broken.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("id"), F.col(n).alias("count")) for n in broken])
    return counts.select(F.explode(pairs).alias("x")).select("x.id", F.when(F.col("x.count") == 0, "pass").otherwise("fail").alias("status"), "x.count")


def fabricated(df: DataFrame) -> Column:
    """Model output on an asset that has no sheet for a model to see."""
    fields = [c for c in ("ai_description", "ai_shot_type", "ai_quality_score", "ai_matched_brief_item_id") if c in df.columns]
    claims = F.lit(False)
    for c in fields:
        claims = claims | F.col(c).isNotNull()
    return F.col("sheet_key").isNull() & (claims | so(F.col("ai_provenance") != "none"))


def mirror_broken(flag: str) -> Column:
    return ~F.coalesce(F.col(flag), F.lit(False)).cast("int").eqNullSafe(F.col(f"{flag}_i"))


def provenance_violations() -> Column:
    """Names of the rules that a run (provider, model_id, simulated_model_id, fixture_id, latency_source) breaks."""
    p = F.col("provider")
    rules = {
        "mock_has_model": (p == "mock") & F.col("model_id").isNotNull(),
        "mock_without_simulated_model": (p == "mock") & F.col("simulated_model_id").isNull(),
        "live_without_model": (p == "live") & F.col("model_id").isNull(),
        "live_has_fixture": (p == "live") & F.col("fixture_id").isNotNull(),
        "live_latency_not_measured": (p == "live") & (F.col("latency_source") != "measured"),
        "replay_without_fixture": (p == "replay") & F.col("fixture_id").isNull(),
        "unknown_provider": ~p.isin("mock", "live", "replay"),
    }
    return F.array_compact(F.array(*[F.when(so(c), name) for name, c in rules.items()]))


def checked_matches(matches: Column) -> Column:
    """Matches (item, verdict, confidence): doubtful ones go, and weak covers become possible."""
    kept = F.filter(matches, lambda m: (m["verdict"] == "no") | (m["confidence"] >= MATCH_FLOOR))
    weak = lambda m: (m["verdict"] == "covers") & (m["confidence"] < COVERS_CONFIDENCE)
    return F.transform(kept, lambda m: F.struct(m["item"].alias("item"), F.when(weak(m), "possible").otherwise(m["verdict"]).alias("verdict"), m["confidence"].alias("confidence")))


def known_terms(terms: Column, taxonomy: Column) -> Column:
    return F.filter(terms, lambda t: F.array_contains(taxonomy, t))


def schema_errors(schema: dict[str, Any], value: Any, path: str = "$") -> Iterator[tuple[str, str, str]]:
    """(path, keyword, message) of what is wrong with a JSON value, in order."""
    if "anyOf" in schema:
        if not any(next(schema_errors(option, value, path), None) is None for option in schema["anyOf"]):
            yield path, "anyOf", "matches none of the alternatives"
        return
    if "const" in schema and schema["const"] != value:
        yield path, "const", f"must be {json.dumps(schema['const'])}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield path, "enum", "is not one of the values"
        return
    kinds = schema.get("type")
    if kinds is not None and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        yield path, "type", f"must be {kinds}"
        return
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        for word, wrong in (("minimum", lambda a, b: a < b), ("maximum", lambda a, b: a > b)):
            if word in schema and wrong(value, schema[word]):
                yield path, word, f"{value} against {schema[word]}"
    elif isinstance(value, str):
        yield from _sized(schema, len(value), path, "Length")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            yield path, "pattern", "has another form"
    elif isinstance(value, list):
        yield from _sized(schema, len(value), path, "Items")
        if schema.get("uniqueItems") and len({json.dumps(v, sort_keys=True) for v in value}) < len(value):
            yield path, "uniqueItems", "has repeats"
        for i, v in enumerate(value):
            yield from schema_errors(schema.get("items", {}), v, f"{path}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                yield f"{path}.{name}", "required", "is missing"
        for name, v in value.items():
            if name in known:
                yield from schema_errors(known[name], v, f"{path}.{name}")
            elif schema.get("additionalProperties", True) is False:
                yield f"{path}.{name}", "additionalProperties", "is not a known key"


def _sized(schema: dict[str, Any], n: int, path: str, what: str) -> Iterator[tuple[str, str, str]]:
    if n < schema.get(f"min{what}", 0):
        yield path, f"min{what}", f"{n} is too few"
    if n > schema.get(f"max{what}", math.inf):
        yield path, f"max{what}", f"{n} is too many"


def _is(kind: str, value: Any) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "null": value is None, "boolean": isinstance(value, bool), "number": number, "integer": number and float(value).is_integer(),
        "string": isinstance(value, str), "array": isinstance(value, list), "object": isinstance(value, dict),
    }[kind]


def validated(df: DataFrame, payload: str, schema: dict[str, Any], cap: int = ERROR_CAP) -> DataFrame:
    """``df`` with ``errors``: what is wrong with the JSON in a column, ``cap`` entries at most."""

    @F.pandas_udf("array<struct<path:string,keyword:string,message:string>>")
    def errors(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            try:
                value = json.loads(text) if text is not None else None
            except ValueError:
                out.append([("$", "json", "is not JSON")])
                continue
            found = schema_errors(schema, value)
            out.append([e for e, _ in zip(found, range(cap), strict=False)])
        return pd.Series([[dict(zip(("path", "keyword", "message"), e, strict=True)) for e in row] for row in out])

    return df.withColumn("errors", errors(F.col(payload)))
