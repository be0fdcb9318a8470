"""inkspan: a text-entity analytics engine expressed as Spark DataFrame operators."""
