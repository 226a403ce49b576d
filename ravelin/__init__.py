"""Tensor regression analytics and corpus operators expressed as Spark jobs."""
