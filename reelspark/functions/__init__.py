"""Part of reelspark: functions."""
