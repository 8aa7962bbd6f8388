"""The operators, one module for each layer of the pipeline."""
