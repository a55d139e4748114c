"""DataFrame operators. Each takes DataFrames and returns a DataFrame (or a Column) and stays lazy
unless its docstring says otherwise."""
