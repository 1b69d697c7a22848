"""Training-data operators: every module here takes and returns DataFrames."""
