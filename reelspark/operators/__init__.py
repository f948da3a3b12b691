"""Part of reelspark: operators."""
