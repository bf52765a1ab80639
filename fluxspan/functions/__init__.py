"""Part of the photometric table engine."""
