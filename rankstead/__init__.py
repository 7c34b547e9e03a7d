"""Rankstead: labelled-score analytics and record processing on PySpark DataFrames."""
