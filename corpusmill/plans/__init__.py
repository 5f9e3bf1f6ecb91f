"""Plans: aggregate questions, sub-questions, ingestion and answering."""
