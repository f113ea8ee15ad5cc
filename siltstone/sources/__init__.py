"""Sources: nested repositories, documents, web, math and function tables, Arrow shards, configuration."""
