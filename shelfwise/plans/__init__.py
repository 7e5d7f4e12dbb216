"""The analyses: each is a DataFrame -> DataFrame function over the raw catalogue."""
