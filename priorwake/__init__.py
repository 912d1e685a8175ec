"""priorwake: strict-prior event analytics and corpus operators on Spark."""
