"""The life of a roster: upload, refresh, comments, dashboard, export.

Every change writes a new snapshot version with the tables it changed; the newest ``retained_versions`` stay.  Nothing
is kept in memory between the calls.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.operators import dashboard, searching
from trailmark.operators.comments import unmatched_comments
from trailmark.operators.export import export_diff, write_export
from trailmark.operators.schema import ensure_schema
from trailmark.plans.commenting import comment
from trailmark.plans.dashboard import dashboard_tables
from trailmark.plans.live import fold_logs
from trailmark.plans.refresh import refresh
from trailmark.sources.log_scan import scan_logs
from trailmark.sources.sheets import read_contacts, read_logs, read_roster
from trailmark.sources.snapshots import Change, Snapshot, SnapshotStore

_TIME = "%Y%m%dT%H%M%S%f"
#: Tables that follow from the processed participants and go when others write these as a whole.
DERIVED = ("roster", "tallies", "postings", "search_rows")


class Tracker:
    """One roster and its snapshots; several trackers and streams may change it at the same time."""

    def __init__(self, store: SnapshotStore, cfg: ProgressConfig = DEFAULT_CONFIG):
        self.store = store
        self.cfg = cfg

    def current(self, roster: DataFrame | None = None) -> Snapshot:
        """Newest snapshot, or an error before the first upload.

        What had to be rebuilt, from an empty processed table or from the given roster, is stored.
        """
        snapshot = self.store.load(self.cfg, roster)
        if snapshot is None:
            raise ValueError("upload a roster first")
        stored = self.store.read()
        if stored is not None and stored.last_sync_at == snapshot.last_sync_at:
            return snapshot

        def build(change: Change) -> bool | None:
            now = self.store.load(self.cfg, roster)
            if change.base is not None and now.last_sync_at == change.base.last_sync_at:
                return False
            change.drop(*DERIVED)
            for name, table in now.tables.items():
                if name == "processed" or name not in change.folders:
                    change.put(name, table)
            return None

        return self._update(snapshot.version or "rebuilt", build, None)

    def _update(self, version: str, build, last_sync_at: datetime | None, source: str | None = None, **kept) -> Snapshot:
        self.store.update(version, build, last_sync_at, source, **kept)
        self.store.expire(self.cfg.retained_versions)
        return self.store.load(self.cfg)

    def upload(self, roster_sheet: DataFrame, contact_sheet: DataFrame, now: datetime, source: str | None = None) -> Snapshot:
        """Start from a roster and a contact sheet; of earlier results only the visits of streams are carried over."""
        roster = read_roster(roster_sheet)

        def build(change: Change) -> None:
            change.keep_only("visits")
            change.put("original", roster)
            change.put("processed", ensure_schema(roster, self.cfg))
            change.put("contacts", read_contacts(contact_sheet))

        return self._update(now.strftime(_TIME), build, None, source or "")

    def sync(self, report: DataFrame, now: datetime, since: date | None = None) -> Snapshot:
        """Bring all processed participants up to date with a log report, from a day on if one is given.

        ``rows`` of the snapshot has how many participants were updated and how many contacts are pending, counted while
        they were written.
        """
        logs = read_logs(report)
        if since is not None:
            logs = scan_logs(logs, since, now, self.cfg)

        def build(change: Change) -> None:
            contacts = change.table("contacts") if "contacts" in change.folders else None
            processed, pending = refresh(change.table("processed"), contacts, logs, now, self.cfg)
            change.drop(*DERIVED)
            change.put("processed", processed)
            if pending is not None:
                change.put("pending", pending)

        self.current()
        return self._update(now.strftime(_TIME), build, now)

    def add_logs(self, report: DataFrame, now: datetime) -> Snapshot:
        """Add a portion of logs: only the participants it changes are classified again, see :func:`fold_logs`."""
        self.current()
        fold_logs(self.store, read_logs(report), now, now.strftime(_TIME), self.cfg)
        return self.store.load(self.cfg)

    def comment(self, comments: DataFrame, now: datetime) -> DataFrame:
        """Write comments to the first row of their id; returns those whose id is unknown."""
        self.current()
        new = self._update(now.strftime(_TIME), lambda change: comment(change, comments), None, keep_sync=True)
        return unmatched_comments(new.tables["processed"], comments)

    def index(self, now: datetime) -> Snapshot:
        """Make the newest participants searchable without reading all of them; any later change drops the index."""
        self.current()

        def build(change: Change) -> None:
            rows = dashboard.records(dashboard.dashboard_input(change.table("processed"), self.cfg), now, self.cfg)
            searching.put_index(change, rows)

        return self._update(now.strftime(_TIME), build, None, keep_sync=True)

    def dashboard(self, now: datetime) -> dict[str, DataFrame]:
        """Dashboard tables of the newest snapshot, the pending contacts, and when it was brought up to date."""
        snapshot = self.current()
        tables = snapshot.tables
        return dashboard_tables(tables["processed"], now, self.cfg, tables.get("pending"), snapshot.last_sync_at, tables.get("tallies"))

    def _records(self, now: datetime) -> DataFrame:
        rows = dashboard.dashboard_input(self.current().tables["processed"], self.cfg)
        return dashboard.records(rows, now, self.cfg)

    def search(self, now: datetime, text: str = "", school: str = "", status: str = "") -> DataFrame:
        """Participants whose id, name or phone has the text, of a school and a status if given."""
        snapshot = self.current()
        indexed = text and {"postings", "search_rows"} <= set(snapshot.tables)
        rows = searching.candidate_rows(self.store, snapshot, text) if indexed else self._records(now)
        return dashboard.search(rows, text, school, status)

    def card(self, now: datetime, identifier: str) -> DataFrame:
        """Detail card of one participant."""
        return dashboard.card(self._records(now), identifier, self.cfg)

    def cohort_members(self, now: datetime, bucket: int) -> DataFrame:
        """Participants of one cohort of weeks since enrolment."""
        rows = dashboard.dashboard_input(self.current().tables["processed"], self.cfg)
        return dashboard.cohort_members(rows, bucket, now, self.cfg)

    def export(self) -> DataFrame:
        """Export rows of the newest snapshot with their changes against the uploaded roster."""
        tables = self.current().tables
        return export_diff(tables["processed"], tables.get("original"), self.cfg)

    def write_export(self, folder: str, day: date) -> str:
        """The export written as Parquet and CSV below a folder of the day; returns that folder."""
        return write_export(self.export(), folder, day)

    def kept_versions(self) -> DataFrame:
        """The versions that are kept."""
        return self.store.versions()
