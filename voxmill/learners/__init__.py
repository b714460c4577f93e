"""Learner families: each trains all of its models in one set of Spark jobs."""

from . import bayes, linear, neighbours, rules, trees
from .base import Learner, State

FAMILIES: dict[str, Learner] = {
    "bayes": bayes.NaiveBayes(),
    "neighbours": neighbours.NearestNeighbours(),
    "linear": linear.Linear(),
    "trees": trees.Trees(),
    "rules": rules.Rules(),
}

__all__ = ["FAMILIES", "Learner", "State"]
