"""Part of papyrine."""
