"""panelweave functions."""
