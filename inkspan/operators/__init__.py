"""Part of the inkspan engine: operators."""
