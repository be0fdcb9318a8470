"""Part of the inkspan engine: streaming."""
