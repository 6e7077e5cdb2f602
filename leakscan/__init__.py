"""Leaked-credential detection over large text corpora, as Spark DataFrame plans."""
