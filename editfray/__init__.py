"""Edit-conflict analytics on Spark: composable DataFrame operators."""
