"""quillframe: text, sequence, array and layout analytics on Spark DataFrames."""
