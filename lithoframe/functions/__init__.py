"""Column helpers and shared dataflow building blocks."""
