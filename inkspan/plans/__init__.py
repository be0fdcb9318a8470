"""Part of the inkspan engine: plans."""
