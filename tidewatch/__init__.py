"""Launch forensics on append-only event and snapshot history, with Spark."""
