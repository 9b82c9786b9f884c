"""Operators from DataFrame to DataFrame; chain them with `df.transform`."""
