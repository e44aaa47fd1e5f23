"""From questions to plans, and from plans to results."""
