"""Part of reelspark: streaming."""
