"""Every operator as a query over the given tables, next to its equivalent SQL."""
