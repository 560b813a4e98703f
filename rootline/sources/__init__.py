"""Where lineage comes from and goes to: stores, files, sidecars, pages."""
