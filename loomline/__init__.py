"""Analytics over archives of posts and discussions, as Spark jobs."""
