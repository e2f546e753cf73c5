"""Jobs put together from several operators."""
