"""Part of the decision-log engine."""
