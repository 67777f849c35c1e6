"""Operators over DataFrames: annotation, collections, normalisation, HGVS conversion, audits."""
