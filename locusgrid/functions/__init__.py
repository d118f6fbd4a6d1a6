"""Part of locusgrid."""
