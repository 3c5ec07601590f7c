"""Part of the research data engine."""
