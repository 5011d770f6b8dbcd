"""Table-agnostic operators: DataFrame -> DataFrame, with column names as arguments."""
