"""Stream ingestion with dead letters, and the live views."""
