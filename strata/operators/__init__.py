"""Relational operators: pure functions from DataFrames to DataFrames; none runs an action unless its docstring says so."""
