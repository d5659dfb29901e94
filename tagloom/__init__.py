"""tagloom: sequence-similarity analytics and training-data operators on Spark DataFrames."""
