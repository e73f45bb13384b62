"""Fleet-scale install inventory and asset analytics as Spark DataFrame operators."""
