"""Part of the scriptorium engine."""
