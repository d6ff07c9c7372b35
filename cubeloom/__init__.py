"""Labelled, gridded data as Spark DataFrames: cubes, a catalogue of cubes and workflows over it."""

from .cube import Cube

__all__ = ["Cube"]
__version__ = "0.1.0"
