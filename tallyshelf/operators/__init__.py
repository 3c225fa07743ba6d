"""Reports, profiles, text jobs and analyses: plain functions from DataFrames to a DataFrame."""
