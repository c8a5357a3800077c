"""Analytics over one snapshot or a pair of snapshots; each takes and returns DataFrames."""
