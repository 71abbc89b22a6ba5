"""The registered queries over the benchmark tables, each beside the SQL that states its expected result."""
