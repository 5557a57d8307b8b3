"""lemmata: answering conditional questions by logic, on Spark DataFrames."""
