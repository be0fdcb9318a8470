"""Part of the inkspan engine: functions."""
