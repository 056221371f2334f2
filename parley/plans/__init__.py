"""Plans over whole tables: loading, and the registered queries."""
