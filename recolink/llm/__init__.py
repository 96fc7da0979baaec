"""Training-data operators. Nothing outside this package imports it but the driver entry and corpus_pipeline."""
