"""Functions that plans may call by name, with the semantics of the plan language rather than of Spark's namesakes."""
