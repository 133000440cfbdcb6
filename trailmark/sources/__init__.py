"""Tables in and out: sheets, log scans, versioned snapshots, encryption."""
