"""quire: bibliometric text analytics as composable Spark DataFrame transforms."""
