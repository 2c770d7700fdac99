"""panelweave operators."""
