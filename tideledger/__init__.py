"""Cash-flow and liquidity analytics as Spark DataFrame operators."""
