"""Text operators of a training-data pipeline.  Nothing outside this subpackage imports it but the entry module."""
