"""Readers and writers: RDF text, lifted tables, property graphs, tabular profiles, reports."""
