"""The registered queries: mapped tables, Spark plans and matching SQL."""
