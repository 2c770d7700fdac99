"""panelweave streaming."""
