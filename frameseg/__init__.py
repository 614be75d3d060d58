"""Segmentation of long recordings as Spark DataFrame operations."""
