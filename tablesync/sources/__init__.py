"""Reading landed records and committing table snapshots."""
