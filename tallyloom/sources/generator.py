"""Invented records of any size, the same for the same seed: every value is a hash of the seed and the row's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values.
ROOMS = ("reception", "lounge", "sauna", "treatment_room", "wet_room", "exterior")
SHOTS = ("wide", "closeup", "macro", "overhead")
REVIEWS = ("pending", "approved", "rejected")
FAILED = ("reception greeting", "steam room detail", "golden hour hands", "exterior")
START_MS, DAY_MS = 1_767_225_600_000, 86_400_000


def draw(seed: int, what: str, n: int) -> Column:
    """0 to n - 1, by row and column."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(n))


def choice(seed: int, what: str, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (draw(seed, what, len(values)) + 1).cast("int"))


def assets(spark: SparkSession, n: int, seed: int = 1, collabs: int = 100, branches: int = 5) -> DataFrame:
    """Clips with all their imperfections: some lack a sheet, some a room, some are upright by rotation only."""
    upright = draw(seed, "upright", 10) > 1
    return spark.range(n).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"),
        F.lit("o1").alias("org_id"),
        F.concat(F.lit("c"), draw(seed, "collab", collabs).cast("string")).alias("collab_id"),
        F.concat(F.lit("b"), draw(seed, "branch", branches).cast("string")).alias("branch_id"),
        F.when(upright, 1080).otherwise(1920).alias("coded_width"),
        F.when(upright, 1920).otherwise(1080).alias("coded_height"),
        F.when(draw(seed, "turn", 12) == 0, 90).otherwise(0).alias("rotation_deg"),
        (draw(seed, "duration", 600) / 10 + 1).alias("duration_s"),
        F.when(draw(seed, "room?", 9) > 0, choice(seed, "room", ROOMS)).alias("ai_room"),
        choice(seed, "shot", SHOTS).alias("ai_shot_type"),
        (draw(seed, "quality", 100) / 100).alias("ai_quality_score"),
        choice(seed, "review", REVIEWS).alias("review_status"),
        (choice(seed, "review", REVIEWS) == "approved").alias("is_published"),
        F.when(draw(seed, "sheet", 20) > 0, F.concat(F.lit("sheet/"), F.col("id").cast("string"))).alias("sheet_key"),
        (START_MS + draw(seed, "made", 90) * DAY_MS).alias("created_at"),
        F.lit(None).cast("long").alias("deleted_at"),
    )


def searches(spark: SparkSession, n: int, seed: int = 1, users: int = 20) -> DataFrame:
    """A search log in which some queries keep finding nothing."""
    failed = draw(seed, "fails", 4) == 0
    words = F.concat_ws(" ", choice(seed, "room", ROOMS), choice(seed, "shot", SHOTS))
    return spark.range(n).select(
        F.concat(F.lit("q"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("u"), draw(seed, "user", users).cast("string")).alias("user_id"),
        F.when(failed, choice(seed, "failed", FAILED)).otherwise(words).alias("text"),
        F.when(failed, 0).otherwise(1 + draw(seed, "results", 30)).cast("long").alias("result_count"),
        (START_MS + draw(seed, "asked", 90 * 1440) * 60_000).alias("created_at"),
    )
