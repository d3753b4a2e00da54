"""lodegraph: property-graph, text and vector analytics on the DataFrame API."""

__version__ = "0.1.0"
