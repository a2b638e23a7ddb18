"""Modelling and scoring on pyspark.ml and plain DataFrame expressions."""
