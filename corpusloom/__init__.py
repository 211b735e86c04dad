"""Audits of text corpora and source trees as Spark jobs."""
