"""DataFrame operators on logs, rosters and contacts."""
