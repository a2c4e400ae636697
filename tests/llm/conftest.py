"""The ``spark`` fixture comes from the folder above."""
