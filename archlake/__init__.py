"""archlake: analytics over software-architecture graphs, written as Spark jobs."""
