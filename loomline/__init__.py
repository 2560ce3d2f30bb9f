"""Evidence-timeline and corpus analytics as functions from DataFrames to DataFrames."""
