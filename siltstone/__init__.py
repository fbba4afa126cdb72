"""Siltstone: code-quality analytics over findings, files, build history and feedback, as Spark DataFrame operators."""
