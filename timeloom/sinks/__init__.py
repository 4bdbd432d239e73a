"""Writers of events."""
