"""Company fundamentals, prices, index membership and stock screening as Spark DataFrame jobs."""
