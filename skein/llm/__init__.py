"""Operations of a training-data pipeline; queries() and oracle_sql() in skein.llm.registry list them."""
