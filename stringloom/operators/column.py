"""An encoded column: a DataFrame of token arrays and its dictionary."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from stringloom.operators.automata import TokenAutomaton
from stringloom.operators.config import TrainingConfig
from stringloom.operators.dictionary import Dictionary
from stringloom.operators.encode import bytes_of, tokens_of
from stringloom.operators.ordering import running
from stringloom.operators.shared import bounded, checkpoint
from stringloom.operators.trainer import train_dictionary, value_bytes
from stringloom.plans.predicate import Contains, ContainsAny, Equals, Predicate, StartsWith, custom

TOKENS = "tokens"


def encode_column(df: DataFrame, key: str, col: str, config: TrainingConfig | None = None, dictionary: Dictionary | None = None, keep: Iterable[str] = ()) -> EncodedColumn:
    """Encode ``df[col]``, STRING or BINARY, under a trained or a given dictionary.

    The result holds ``key``, the columns ``keep`` and the tokens.
    """
    config = config or TrainingConfig()
    dictionary = dictionary or train_dictionary(df, key, col, config)
    rows = df.select(key, *keep, F.lit(0).alias("dict_id"), tokens_of(value_bytes(df, col), dictionary).alias(TOKENS))
    return EncodedColumn(rows, dictionary, key, config.bits, df.schema[col].dataType.typeName() == "string")


@dataclass(frozen=True)
class EncodedColumn:
    """Read access to an encoded column; every method gives an ordinary DataFrame."""

    df: DataFrame
    dictionary: Dictionary
    key: str
    bits: int = 16
    text: bool = True  # values are STRING, not BINARY

    def __post_init__(self):
        bounded(self.df)

    @property
    def tokens(self) -> Column:
        return F.col(TOKENS)

    def where(self, predicate: Predicate | TokenAutomaton, mode: str = "lazy", *, native: bool = True) -> DataFrame:
        """The encoded rows that satisfy a predicate or an automaton of one's own."""
        if isinstance(predicate, Predicate):
            return self.df.filter(predicate.tokens(self.tokens, self.dictionary, mode, native=native))
        return self.df.filter(custom(predicate)(self.tokens))

    def scan(self, predicate: Predicate | TokenAutomaton, mode: str = "lazy", *, native: bool = True) -> DataFrame:
        """The keys of the rows that satisfy it."""
        return self.where(predicate, mode, native=native).select(self.key)

    def scan_each(self, predicate: Predicate | TokenAutomaton, on_match: Callable[[Row], None]) -> None:
        """Call ``on_match`` with each matching key, on the executors."""

        def each(rows):
            for r in rows:
                on_match(r)

        self.scan(predicate).foreachPartition(each)

    def contains(self, pattern: str | bytes) -> DataFrame:
        return self.scan(Contains(pattern))

    def starts_with(self, pattern: str | bytes) -> DataFrame:
        return self.scan(StartsWith(pattern))

    def equals(self, value: str | bytes) -> DataFrame:
        return self.scan(Equals(value))

    def contains_any(self, patterns: Iterable[str | bytes]) -> DataFrame:
        return self.scan(ContainsAny(patterns))

    def _value(self, native: bool | None) -> Column:
        out = bytes_of(self.tokens, self.dictionary, native=native)
        return out.cast("string") if self.text else out

    def decompress(self, key, name: str = "value") -> DataFrame:
        """The value of one row."""
        return self.df.filter(F.col(self.key) == key).select(self.key, self._value(None).alias(name))

    def decompress_all(self, name: str = "value", *, native: bool | None = None) -> DataFrame:
        """Every row's value."""
        return self.df.select(self.key, self._value(native).alias(name))

    def decompress_offsets(self, name: str = "value", offset: str = "offset") -> DataFrame:
        """Every row's value and its first byte in the concatenation of all values in key order."""
        rows = self.decompress_all(name).withColumn("__bytes", F.octet_length(name).cast("long"))
        # Written out, so that sampling the key's ranges does not decode every row once more.
        return running(checkpoint(rows), self.key, "__bytes", offset).select(self.key, name, offset)

    def token_rows(self) -> DataFrame:
        """One row a token: key, pos, token."""
        return self.df.select(self.key, F.posexplode(self.tokens).alias("pos", "token"))

    def dictionary_frame(self) -> DataFrame:
        return self.dictionary.frame(self.df.sparkSession)

    def stats(self) -> DataFrame:
        """Counts and sizes in bytes, as one row."""
        d = self.dictionary
        n, t = F.count("*"), F.coalesce(F.sum(F.when(self.tokens.isNotNull(), F.size(self.tokens))), F.lit(0)).cast("long")
        row = self.df.agg(n.alias("num_strings"), t.alias("num_tokens")).select(
            F.lit(0).alias("dict_id"), F.lit(self.bits).alias("bits"), "num_strings", "num_tokens", F.lit(len(d)).cast("long").alias("dict_tokens"),
            (F.ceil(F.col("num_tokens") * self.bits / 8) + 4 * (F.col("num_strings") + 1)).cast("long").alias("store_bytes"), F.lit(d.bytes_used).cast("long").alias("dict_bytes"),
        )
        return row.withColumn("bytes_used", F.col("store_bytes") + F.col("dict_bytes"))
