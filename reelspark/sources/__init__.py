"""Part of reelspark: sources."""
