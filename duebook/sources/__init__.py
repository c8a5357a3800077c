"""Reading, cleaning and writing snapshots."""
