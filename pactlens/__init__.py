"""Contract-portfolio analytics as Spark DataFrame operators."""
