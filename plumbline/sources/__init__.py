"""RDF sources and sinks."""
