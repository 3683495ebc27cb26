"""threadloom: conversation-context analytics expressed as Spark plans."""
