"""A document-transform and analytics engine that compiles to Spark plans."""
