"""textmill: text-to-vector work and its bookkeeping, written as Spark DataFrame jobs."""
