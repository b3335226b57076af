"""Part of the tessera analytics engine."""
