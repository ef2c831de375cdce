"""scrollwork: text analytics, ledgers and corpus preparation as Spark DataFrame operators."""
