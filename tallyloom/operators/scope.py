"""Role-scoped views: access list, then row predicate, then the caller's predicate, then columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Session:
    kind: str
    org_id: str
    user_id: str | None = None
    #: Branches that a manager is confined to; None is all of them.
    branch_scope: tuple[str, ...] | None = None
    collab_id: str | None = None
    creator_id: str | None = None


def manager(org_id: str, user_id: str, branch_scope: list[str] | None = None) -> Session:
    return Session("manager", org_id, user_id, None if branch_scope is None else tuple(branch_scope))


def editor(org_id: str, user_id: str) -> Session:
    return Session("editor", org_id, user_id)


def creator_token(org_id: str, collab_id: str) -> Session:
    return Session("creator_token", org_id, None, None, collab_id)


def with_creator(session: Session, creator_id: str) -> Session:
    return replace(session, creator_id=creator_id)


class ScopeError(PermissionError):
    """A session reads or writes a table that its role has nothing to do with."""


#: Tables that a role reads, and those that it writes too.
READS = {
    "manager": {"org", "usage_event"},
    "editor": {"org", "app_user", "branch", "asset", "contact_sheet", "asset_frame", "gap_scan", "insight", "blob", "search_token", "asset_facet", "meta"},
    "creator_token": {"branch", "creator", "collab", "brief", "brief_item"},
}
WRITES = {
    "manager": {
        "app_user", "branch", "creator", "collab", "brief", "brief_item", "delivery", "asset", "contact_sheet", "asset_frame", "tag_vocabulary", "tag", "ai_run",
        "access_token", "review_action", "review_session", "consent_record", "search_query_log", "saved_collection", "collection_item", "gap", "gap_scan",
        "gap_dismissal", "insight", "blob", "search_token", "asset_facet", "reindex_queue", "sync_state", "meta",
    },
    "editor": {"tag_vocabulary", "tag", "ai_run", "search_query_log", "saved_collection", "collection_item", "usage_event", "gap"},
    "creator_token": {"delivery", "asset", "contact_sheet", "asset_frame", "consent_record", "blob"},
}
#: Columns that leave a table for a role; a table that isn't named leaves whole.
COLUMNS = {
    ("editor", "asset"): (
        "id org_id created_at updated_at kind branch_id filename duration_s coded_width coded_height rotation_deg codec_video has_audio captured_at captured_at_source "
        "client_decodable needs_transcode ai_description ai_shot_type ai_room ai_subjects ai_quality_score ai_framing_score ai_confidence ai_provenance review_status "
        "is_published is_hero media_state derivative_state poster_key sheet_key bytes_key used_count download_count creator_credit usage_scope"
    ),
    ("editor", "branch"): "id name city timezone rooms",
    ("editor", "app_user"): "id display_name role",
    ("creator_token", "asset"): (
        "id kind filename duration_s coded_width coded_height captured_at captured_at_source preflight preflight_version review_status confirmed_brief_item_id "
        "creator_claimed_brief_item_id creator_facing_note media_state derivative_state poster_key sheet_key"
    ),
    ("creator_token", "collab"): "id branch_id stage visit_at usage_terms_text consent_text_version consent_accepted_at",
    ("creator_token", "creator"): "id display_name primary_handle",
    ("creator_token", "branch"): "id name address city timezone lat lng",
}


def _true(condition: Column) -> Column:
    """Two-valued: what isn't known isn't so."""
    return F.coalesce(condition, F.lit(False))


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


def visible(session: Session, table: str, df: DataFrame) -> Column:
    """The rows of a table that are there for a session; the caller can't opt out."""
    live = _given(df, "deleted_at").isNull()
    org = _given(df, "org_id")
    base = live & (org.isNull() | (org == session.org_id))
    if session.kind == "manager":
        if session.branch_scope is None or "branch_id" not in df.columns:
            return base
        return base & (F.col("branch_id").isNull() | F.col("branch_id").isin(list(session.branch_scope)))
    if session.kind == "editor":
        if table == "asset":
            return base & _true(_given(df, "is_published")) & _true(_given(df, "review_status") == "approved")
        if table == "ai_run":
            return base & _true(_given(df, "kind").isin("vision_tag", "search_parse"))
        if table in ("saved_collection", "collection_item", "search_query_log"):
            return base & (_true(_given(df, "owner_user_id") == session.user_id) | _true(_given(df, "user_id") == session.user_id) | _true(_given(df, "is_shared")))
        return base
    if table == "collab":
        return base & _true(F.col("id") == session.collab_id)
    if table == "creator":
        return base & _true(F.col("id") == session.creator_id) if session.creator_id is not None else F.lit(False)
    if table == "asset":
        return base & (_true(F.col("collab_id") == session.collab_id) | _true(_given(df, "is_exemplar")))
    if table in ("brief", "delivery", "consent_record"):
        return base & _true(F.col("collab_id") == session.collab_id)
    return base if table in ("brief_item", "contact_sheet", "asset_frame", "branch") else F.lit(False)


def writable(session: Session, table: str, rows: DataFrame) -> Column:
    if session.kind == "editor" and table == "ai_run":
        return _true(_given(rows, "kind") == "search_parse")
    return F.lit(True)


def scoped_view(session: Session, table: str, df: DataFrame, where: Column | None = None) -> DataFrame:
    """``df`` as a session sees it.  ``where`` is tested on whole rows, before columns are left out."""
    if table not in READS[session.kind] | WRITES[session.kind]:
        raise ScopeError(f"{session.kind} may not read {table}")
    seen = df.filter(visible(session, table, df))
    if where is not None:
        seen = seen.filter(_true(where))
    allowed = COLUMNS.get((session.kind, table))
    return seen if allowed is None else seen.select(*[c for c in allowed.split() if c in df.columns])


def owned_children(session: Session, table: str, df: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """A token's view of a table that is reached through a parent: only rows of parents that it sees."""
    return scoped_view(session, table, df.join(parents.select(F.col("id").alias(key)), key, "left_semi"))


def check_write(session: Session, table: str, rows: DataFrame) -> DataFrame:
    """``rows`` if a session may write them; a row that it may not fails the job."""
    if table not in WRITES[session.kind]:
        raise ScopeError(f"{session.kind} may not write {table}")
    allowed = F.when(writable(session, table, rows), True).otherwise(F.raise_error(F.lit(f"{session.kind} may not write this row to {table}")).cast("boolean"))
    return rows.filter(allowed)
