"""arcweave: typed dependency graphs and corpus work as Spark jobs."""
