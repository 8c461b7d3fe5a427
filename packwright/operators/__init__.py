"""Data quality, schema, descriptor and vocabulary operators over DataFrames."""
