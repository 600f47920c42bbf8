"""inkwell: paged text to linked, dated and measurable facts, on Spark DataFrames."""
