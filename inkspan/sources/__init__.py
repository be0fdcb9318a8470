"""Part of the inkspan engine: sources."""
