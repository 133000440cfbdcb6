"""Screens, sections and progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.config import DEFAULT_CONFIG, ProgressConfig


def section_of(screen: Column) -> Column:
    """Section a screen belongs to: the text before ``_``, else its first six characters."""
    return F.when(F.contains(screen, F.lit("_")), F.split_part(screen, F.lit("_"), F.lit(1))).otherwise(
        F.left(screen, F.lit(6))
    )


def _step(section: Column, cfg: ProgressConfig) -> Column:
    """Position of a section counted from 1; 0 if it is unknown or NULL."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, cfg.sections)), section), F.lit(0))


def section_index(section: Column, cfg: ProgressConfig) -> Column:
    """Position of a section counted from 0; -1 if it is unknown or NULL."""
    return (_step(section, cfg) - 1).cast("int")


def progress_pct(screen: Column, cfg: ProgressConfig) -> Column:
    """Share of the sequence reached with a screen, 0 to 100."""
    return _step(section_of(screen), cfg) / F.lit(float(len(cfg.sections))) * F.lit(100.0)


def lookup(labels: dict[str, str], key: Column) -> Column:
    """Value of a small fixed table, NULL for other keys."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, key)


def section_label(section: Column, cfg: ProgressConfig) -> Column:
    """Label of a section, the section itself if it has none."""
    return F.coalesce(lookup(cfg.section_labels, section), section)


def funnel_label(ordered: Column) -> Column:
    """Ordered funnel label without its number."""
    return F.substr(ordered, F.lit(4))


def badge(status: Column, cfg: ProgressConfig = DEFAULT_CONFIG) -> Column:
    """Badge of a status, by the first wording it contains."""
    chain = None
    for word, name in cfg.badges.items():
        hit = F.contains(status, F.lit(word))
        chain = F.when(hit, F.lit(name)) if chain is None else chain.when(hit, F.lit(name))
    return chain.otherwise(F.lit(cfg.other_badge))
