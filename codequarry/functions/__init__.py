"""SQL functions, table functions and worker set-up."""
