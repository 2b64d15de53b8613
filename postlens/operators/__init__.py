"""DataFrame → DataFrame operators: analyses, chart follow-ups, classifier."""

from postlens.operators import analyses, charts, classifier

__all__ = ["analyses", "charts", "classifier"]
