"""A bounded memory store as plain Spark tables: listing, decay, forgetting, search, rules."""
