"""Every analysis as a query over the driver's tables, and the DuckDB SQL that gives the same rows."""
