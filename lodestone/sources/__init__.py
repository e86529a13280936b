"""Sources and sinks of the corpus, the evaluation files, the index and the log."""
