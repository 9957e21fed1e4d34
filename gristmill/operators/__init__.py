"""The engine's operators: every one takes DataFrames and gives lazy DataFrames in frozen results."""
