"""panelweave sources."""
