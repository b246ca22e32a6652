"""Analytics over large collections of action plans, written as Spark jobs."""
