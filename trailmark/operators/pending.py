"""Contacts that may be added to the roster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import ProgressConfig
from trailmark.functions.text import full_name, normalise_id, strip, text_of
from trailmark.operators.joins import join_by_key
from trailmark.sources.sheets import require_columns


def pending_contacts(contacts: DataFrame, participants: DataFrame, cfg: ProgressConfig) -> DataFrame:
    """Eligible contacts whose identifier is not on the roster; repeated contacts stay repeated."""
    require_columns(contacts, ["id", "school", "phone", "contact_state"])
    eligible = contacts.where(F.lower(strip(F.col("contact_state"))) == cfg.eligible_contact_state).select(
        normalise_id(text_of(contacts, "id")).alias("id"),
        "school",
        full_name(*[F.col(f"adult_name_{i}") for i in (1, 2, 3)]).alias("adult_name"),
        text_of(contacts, "phone").alias("phone"),
        full_name(*[F.col(f"child_name_{i}") for i in (1, 2, 3)]).alias("child_name"),
    )
    known = participants.select(normalise_id(text_of(participants, "id")).alias("id")).distinct()
    return join_by_key(eligible, known, "id", "left_anti")
