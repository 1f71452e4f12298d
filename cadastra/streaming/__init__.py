"""Checks of units that arrive file by file: an extension, as the engine this one follows has no streams."""
