"""String-column analytics on PySpark: literal predicates, a token codec, and document operators."""

from stringloom.operators.column import EncodedColumn, encode_column
from stringloom.operators.config import DynamicThreshold, FixedThreshold, TrainingConfig
from stringloom.operators.dictionary import Dictionary
from stringloom.plans.predicate import And, Contains, ContainsAny, Equals, Not, Or, Predicate, StartsWith

__all__ = ["And", "Contains", "ContainsAny", "Dictionary", "DynamicThreshold", "EncodedColumn", "Equals", "FixedThreshold", "Not", "Or", "Predicate", "StartsWith", "TrainingConfig", "encode_column"]
