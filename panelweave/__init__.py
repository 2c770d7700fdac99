"""Spark-first engine for page-layout, text-repair and viewport-stream processing."""
