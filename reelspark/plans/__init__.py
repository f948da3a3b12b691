"""Part of reelspark: plans."""
