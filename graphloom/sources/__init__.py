"""Where quads come from and go to: tables, RDF text, Parquet stores, JSON."""
