"""Audit, curation, sampling, linear modelling and evaluation of labelled text tables on Spark."""
