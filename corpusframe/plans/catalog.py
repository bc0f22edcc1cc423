"""All registered queries. Importing a family registers it."""

from corpusframe.plans import (q_text, q_extract, q_validate, q_repair, q_normalise, q_corpus, q_vectors, q_evaluate)  # noqa: F401
from corpusframe.plans.registry import ORACLES, QUERIES  # noqa: F401
