"""The core's query modules, in the order in which they are registered."""

from brujula.plans import casework, evaluation, quality, reports, scores, tables, texts

MODULES = [quality, tables, texts, scores, reports, casework, evaluation]
FLAGSHIP = "inbox"
