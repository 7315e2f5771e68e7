"""Operators over DataFrames of documents, pages and chat turns."""
