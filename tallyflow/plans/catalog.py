"""All registered queries; importing the plan modules fills the registry."""
from tallyflow.plans import models, searches, sequences, tables  # noqa: F401
from tallyflow.plans.registry import ORACLES, QUERIES  # noqa: F401
