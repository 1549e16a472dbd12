"""Readers and writers: table stores, rankings, questions, properties, JSON, HTML, TSV."""
