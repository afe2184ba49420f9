"""Operators over keyed tables and DataFrames."""
