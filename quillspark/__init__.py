"""quillspark: media-attention and hazard analytics as Spark DataFrame operations."""
