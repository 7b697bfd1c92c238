"""Plumbline: geospatial, survey and table analytics as Spark DataFrame operators."""
