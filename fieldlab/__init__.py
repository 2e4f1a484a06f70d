"""DataFrame operators for field-recording catalogs, labelled samples and their evaluation."""
