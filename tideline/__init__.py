"""Tideline: event, market and corpus analytics expressed as Spark DataFrame programs."""
