"""Résumé-intake analytics on Spark: tables in, tables out."""
