"""Content-intelligence jobs on Spark: raw documents in, ranked daily editions out."""
