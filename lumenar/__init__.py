"""Lumenar: Spark-first operators over media metadata, transcripts and web text."""
