"""Layered batch, streaming and serving analytics as Spark DataFrame operators."""
