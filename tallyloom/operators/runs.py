"""Runs of a model over many requests: hash, render, look up, produce once, validate, and record.

A request's cache key is the hash of its input's canonical form, of the prompt and of the model's name.  What
the memo holds is taken from it; of the rest each distinct key is produced once, however many requests
share it, and put into the memo if the answer is valid.  Requests that may not be made at all are told why
and leave no trace.  Memo and run rows are one batch: run again, it changes nothing.

The model is the caller's: ``produce`` makes a frame of answers from a frame of prompts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.canonical import content_hash
from tallyloom.operators.capabilities import filled
from tallyloom.sources.batches import Batches
from tallyloom.sources.stages import cut

#: What a run of a kind hangs off (type of the subject, field of its id).
SUBJECTS = {
    "vet": ("creator", "creator_id"), "brief_gen": ("brief", "brief_id"), "vision_tag": ("asset", "asset_id"), "brief_match": ("brief_item", "brief_item_id"),
    "search_parse": ("query", "input_hash"), "gap_scan": ("gap_scan", "gap_scan_id"), "nudge_draft": ("collab", "collab_id"),
}
#: Fields without which a failure is no evidence of anything.
COMPLETE = ("kind", "provider", "prompt_hash", "input_hash", "model_key", "schema_key", "latency_source", "status")

#: Keywords of a schema that are checked on receipt and never sent.
LOCAL_KEYWORDS = ("minimum", "maximum", "minLength", "maxLength", "minItems", "maxItems", "uniqueItems")

META = (
    "kind string, provider string, model_id string, simulated_model_id string, prompt_key string, prompt_version string, prompt_hash string, input_hash string, model_key string, "
    "schema_key string, schema_version string, schema_valid boolean, latency_ms long, latency_source string, status string, error_code string"
)
TABLES = {
    "memo": ("cache_key string, output string, latency_ms long", "cache_key"),
    "ai_run": (f"request_id string, subject_type string, subject_id string, {META}, output string", "request_id"),
}


@dataclass(frozen=True)
class Call:
    """What is the same for all requests of a batch; ``valid`` tells of an answer (JSON text) whether it keeps the schema."""

    kind: str
    provider: str
    model: str
    template: str
    prompt_version: str
    schema_key: str
    schema_version: str
    valid: Callable[[Column], Column]
    #: Names that ``values`` holds for the template.
    slots: tuple[str, ...] = ()

    @property
    def model_key(self) -> str:
        return f"{self.provider}:{self.model}"


def refusal(kind: str, df: DataFrame) -> Column:
    """Why a request may not be made: a clip without a sheet can't be tagged, and a run needs its subject."""
    out = F.lit(None).cast("string")
    own = SUBJECTS[kind][1]
    if own != "input_hash":
        out = F.when(F.col(own).isNull() if own in df.columns else F.lit(True), f"missing_{own}").otherwise(out)
    if kind == "vision_tag":
        sheet = F.col("sheet_key") if "sheet_key" in df.columns else F.lit(None)
        out = F.when(F.trim(F.coalesce(sheet, F.lit(""))) == "", "no_stills").otherwise(out)
    return out


def _meta(call: Call) -> dict[str, Column]:
    """The fields of a run that follow from the call: which model it was is never an argument of a run."""
    live = call.provider == "live"
    known = {
        "kind": call.kind, "provider": call.provider, "model_id": None if call.provider == "mock" else call.model, "simulated_model_id": call.model if call.provider == "mock" else None,
        "prompt_key": call.kind, "prompt_version": call.prompt_version, "model_key": call.model_key, "schema_key": call.schema_key, "schema_version": call.schema_version,
        "latency_source": "measured" if live else "simulated",
    }
    return {n: F.lit(v).cast("string") for n, v in known.items()} | {"prompt_hash": F.sha2(F.lit(call.template), 256)}


def complete(rows: DataFrame) -> Column:
    """Whether a run's metadata is whole."""
    out = F.lit(True)
    for name in COMPLETE:
        out = out & F.col(name).isNotNull()
    return out


def run(book: Batches, batch: str, call: Call, requests: DataFrame, produce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(request_id, reason) of requests (request_id, input: JSON text, values: map for the prompt, subjects' ids) that may not be made; all others are run.

    ``produce`` takes (cache_key, input, prompt) and gives (cache_key, output, latency_ms, error_code): no row is
    ``no_answer``.  An answer that breaks its schema is a failure with the answer kept; failures aren't remembered.
    """
    judged = cut(requests.withColumn("reason", refusal(call.kind, requests)))
    refused = judged.filter("reason IS NOT NULL").select("request_id", "reason")
    if book.has(batch):
        return refused
    go = judged.filter("reason IS NULL").withColumn("input_hash", content_hash("input"))
    key = F.sha2(F.concat("input_hash", F.lit("|"), F.sha2(F.lit(call.template), 256), F.lit("|"), F.lit(call.model_key)), 256)
    # a slot that the values don't name is a fault of the template, and stops the batch
    prompt = filled(call.template, {n: F.col("values")[n] for n in call.slots})
    go = cut(go.withColumns({"cache_key": key, "prompt": prompt}))
    memo = book.current("memo")
    missing = go.join(memo.select("cache_key"), "cache_key", "left_anti").filter("cache_key IS NOT NULL").dropDuplicates(["cache_key"])
    made = missing.select("cache_key").join(produce(missing.select("cache_key", "input", "prompt")), "cache_key", "left")
    valid = F.coalesce(call.valid(F.col("output")), F.lit(False))
    code = F.coalesce("error_code", F.when(F.col("output").isNull(), "no_answer").when(~valid, "invalid_output"))
    told = cut(made.select("cache_key", "output", "latency_ms", code.alias("error_code")))
    fresh = told.filter("error_code IS NULL").select("cache_key", "output", "latency_ms")
    answers = memo.withColumn("error_code", F.lit(None).cast("string")).unionByName(told)
    code = F.when(F.col("cache_key").isNull(), "not_json").otherwise(F.col("error_code"))
    subject, own = SUBJECTS[call.kind]
    rows = go.join(answers, "cache_key", "left").withColumns(_meta(call)).withColumns({
        "error_code": code, "status": F.when(code.isNull(), "ok").when(code == "refused", "refused").otherwise("error"),
        "schema_valid": F.coalesce(code != "invalid_output", F.lit(True)), "subject_type": F.lit(subject), "subject_id": F.col(own).cast("string"),
    })
    book.commit(batch, {"memo": fresh, "ai_run": rows.filter((F.col("status") == "ok") | complete(rows))})
    return refused


def wire_schema(schema: dict, dropped: tuple[str, ...] = LOCAL_KEYWORDS) -> dict:
    """A JSON schema without the keywords that are checked here alone; names of properties are no keywords."""
    deeper = {
        "properties": lambda v: {name: wire_schema(child, dropped) for name, child in v.items()},
        "items": lambda v: wire_schema(v, dropped),
        "anyOf": lambda v: [wire_schema(child, dropped) for child in v],
    }
    return {k: deeper[k](v) if k in deeper and v else v for k, v in schema.items() if k not in dropped}
