"""tidemark: analytics over replicated command logs, versions, histories, traces and ledgers, on Spark."""
