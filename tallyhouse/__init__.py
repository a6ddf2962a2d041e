"""Business-metric rollups and data-quality monitoring as Spark DataFrame operators."""
