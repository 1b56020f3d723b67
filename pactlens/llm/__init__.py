"""Operators for preparing language-model training data on Spark. Nothing outside this folder imports it."""
