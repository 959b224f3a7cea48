"""Registration pipelines."""
