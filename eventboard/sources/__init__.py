"""Reading snapshots, feeds, status documents and result records; writing the live tables."""
