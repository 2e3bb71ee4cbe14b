"""Relational operators of the analysis: sections, branches of detection, reports, evaluation."""
