"""Operators over DataFrames. Each stays lazy and adds only the shuffles its keys need."""
