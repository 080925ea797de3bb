"""Planners: SPARQL, SHACL, ShEx and property-graph schemas to DataFrame plans."""
