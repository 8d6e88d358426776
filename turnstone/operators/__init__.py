"""Operators over DataFrames of turns, memories, drawers and facts."""
