"""The registered queries on string columns and their SQL oracles.

Every raw query has a twin on encoded tokens with the same oracle.  Queries named
``compose_`` put a predicate in front of a join or an aggregate.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stringloom.functions.sql import register
from stringloom.operators.automata import TokenAutomaton
from stringloom.operators.column import EncodedColumn, encode_column
from stringloom.operators.config import DynamicThreshold, FixedThreshold, TrainingConfig
from stringloom.operators.dictionary import Dictionary
from stringloom.operators.ordering import row_ids
from stringloom.operators.shared import fresh_path
from stringloom.operators.trainer import train_dictionary
from stringloom.plans.predicate import Contains, ContainsAny, Equals, Predicate, StartsWith
from stringloom.sources import blob, storage
from stringloom.streaming.scan import filter_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Dictionaries are trained once a session for a column and a setting.
_TRAINED: dict[tuple, Dictionary] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def encoded(spark: SparkSession, sf_dir: str, table: str, key: str, col: str, config: TrainingConfig | None = None) -> EncodedColumn:
    """A column of a table under its trained dictionary."""
    config = config or TrainingConfig(bits=12)
    df = read(spark, sf_dir, table)
    name = (spark.sparkContext.applicationId, sf_dir, table, col, config)
    if name not in _TRAINED:
        _TRAINED[name] = train_dictionary(df, key, col, config)
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:  # a small table in one piece; larger ones are encoded where they are read
        df = df.select(key, col).repartition(cores)
    return encode_column(df, key, col, config, _TRAINED[name])


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


MANY = tuple(f"t{c}{d}" for c in "aehinorst" for d in "aehinorst")
#: name -> table, key, column, predicate, SQL condition
SCANS: dict[str, tuple[str, str, str, Predicate, str]] = {
    "contains_substring": ("documents", "doc_id", "text", Contains("license"), "contains(text, 'license')"),
    "contains_utf8": ("documents", "doc_id", "text", Contains("é"), "contains(text, 'é')"),
    "contains_empty": ("documents", "doc_id", "text", Contains(""), "contains(text, '')"),
    "contains_literal_meta": ("customer", "c_custkey", "c_name", Contains("#") & ~Contains("_") & ~Contains("%"), "contains(c_name, '#') AND NOT contains(c_name, '_') AND NOT contains(c_name, '%')"),
    "contains_self_overlap": ("documents", "doc_id", "text", Contains("erer"), "contains(text, 'erer')"),
    "starts_with": ("pages", "page_id", "url", StartsWith("https://"), "starts_with(url, 'https://')"),
    "starts_with_empty": ("part", "p_partkey", "p_name", StartsWith(""), "true"),
    "starts_with_shared": ("customer", "c_custkey", "c_name", StartsWith("Customer#00000012"), "starts_with(c_name, 'Customer#00000012')"),
    "equals": ("part", "p_partkey", "p_type", Equals("PROMO"), "p_type = 'PROMO'"),
    "equals_json": ("events", "event_id", "props", Equals('{"k": 69}'), "props = '{\"k\": 69}'"),
    "equals_empty": ("part", "p_partkey", "p_name", Equals(""), "p_name = ''"),
    "contains_any": ("pages", "page_id", "url", ContainsAny([".com/", ".net/"]), "contains(url, '.com/') OR contains(url, '.net/')"),
    "contains_any_empty_set": ("pages", "page_id", "url", ContainsAny([]), "false"),
    "contains_any_empty_pattern": ("pages", "page_id", "url", ContainsAny(["", "x"]), "true"),
    "contains_any_many": ("part", "p_partkey", "p_name", ContainsAny(MANY), " OR ".join(f"contains(p_name, '{p}')" for p in MANY)),
    "not_contains": ("part", "p_partkey", "p_name", ~Contains("ring"), "NOT contains(p_name, 'ring')"),
    "and_both": ("part", "p_partkey", "p_name", Contains("small") & Contains("ring"), "contains(p_name, 'small') AND contains(p_name, 'ring')"),
    "or_either": ("part", "p_partkey", "p_name", Contains("ring") | StartsWith("red"), "contains(p_name, 'ring') OR starts_with(p_name, 'red')"),
    "nested_boolean": ("part", "p_partkey", "p_name", (StartsWith("small") | Equals("red widget")) & ~Contains("ring"), "(starts_with(p_name, 'small') OR p_name = 'red widget') AND NOT contains(p_name, 'ring')"),
    "contains_not_equal": ("part", "p_partkey", "p_type", Contains("PROMO") & ~Equals("PROMO"), "contains(p_type, 'PROMO') AND NOT p_type = 'PROMO'"),
    "same_twice": ("part", "p_partkey", "p_name", (Contains("ring") & Contains("ring")) | ~~Equals("red ring"), "contains(p_name, 'ring') OR p_name = 'red ring'"),
}


def _raw(table: str, key: str, col: str, predicate: Predicate) -> Query:
    return lambda spark, sf_dir: filter_rows(read(spark, sf_dir, table), col, predicate).select(key)


def _coded(table: str, key: str, col: str, predicate: Predicate, mode: str = "lazy", native: bool = True) -> Query:
    return lambda spark, sf_dir: encoded(spark, sf_dir, table, key, col).scan(predicate, mode, native=native)


for _name, (_table, _key, _col, _predicate, _sql) in SCANS.items():
    QUERIES[_name] = _raw(_table, _key, _col, _predicate)
    QUERIES[f"encoded_{_name}"] = _coded(_table, _key, _col, _predicate)
    ORACLE_SQL[_name] = ORACLE_SQL[f"encoded_{_name}"] = f"SELECT {_key} FROM {_table} WHERE {_sql}"
for _mode in ("eager", "lazy", "online"):
    QUERIES[f"encoded_any_{_mode}"] = _coded(*SCANS["contains_any"][:4], _mode)
    QUERIES[f"encoded_fused_{_mode}"] = _coded(*SCANS["nested_boolean"][:4], _mode, False)
    ORACLE_SQL[f"encoded_any_{_mode}"], ORACLE_SQL[f"encoded_fused_{_mode}"] = ORACLE_SQL["contains_any"], ORACLE_SQL["nested_boolean"]


@query("SELECT page_id FROM pages WHERE contains(url, '.org/')")
def contains_binary(spark, sf_dir):
    """A BINARY column takes the same predicates."""
    df = read(spark, sf_dir, "pages").select("page_id", F.col("url").cast("binary").alias("b"))
    return filter_rows(df, "b", Contains(b".org/")).select("page_id")


@query("SELECT c_custkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS v FROM customer) WHERE NOT contains(v, '7')")
def null_rows(spark, sf_dir):
    """Nulls satisfy neither a predicate nor its negation, raw or encoded."""
    df = read(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("v"))
    return encode_column(df, "c_custkey", "v", TrainingConfig(bits=10)).scan(~Contains("7"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_custkey, c_name FROM customer")
def row_positions(spark, sf_dir):
    """0-based row ids in key order."""
    return row_ids(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")


@query("SELECT row_id FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_id, c_name FROM customer) WHERE contains(c_name, '99')")
def scan_row_positions(spark, sf_dir):
    """Matches as ascending row ids."""
    rows = row_ids(read(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    return filter_rows(rows, "c_name", Contains("99")).select("row_id").orderBy("row_id")


@query("SELECT page_id FROM pages WHERE (contains(url, '.com/') OR contains(url, '.net/')) AND NOT starts_with(url, 'http://') AND NOT url = 'x' AND contains(url, 'e')")
def sql_functions(spark, sf_dir):
    """The predicates from SQL text."""
    register(spark)
    df = read(spark, sf_dir, "pages")
    return df.filter("text_contains_any(url, array('.com/', '.net/')) AND NOT text_starts_with(url, 'http://') AND NOT text_equals(url, 'x') AND text_contains(url, 'e')").select("page_id")


class EvenTokens(TokenAutomaton):
    """Accepts rows whose bytes hold an even number of one byte."""

    def __init__(self, dictionary: Dictionary, byte: bytes):
        self.count = [t.count(byte) for t in dictionary.tokens]
        self.reset()

    def reset(self):
        self.seen = 0

    def step(self, token):
        self.seen += self.count[token]

    def is_accepted(self):
        return self.seen % 2 == 0


@query("SELECT p_partkey FROM part WHERE (length(p_name) - length(replace(p_name, 'e', ''))) % 2 = 0 AND contains(p_name, 'r')")
def custom_automaton(spark, sf_dir):
    """An automaton of one's own, combined with a built-in one."""
    col = encoded(spark, sf_dir, "part", "p_partkey", "p_name")
    return col.scan(EvenTokens(col.dictionary, b"e") & Contains("r").automaton(col.dictionary))


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'ring') AND NOT p_name = 'red ring'")
def custom_and_column(spark, sf_dir):
    """Automaton verdicts are columns, and combine with Catalyst predicates."""
    from stringloom.plans.predicate import custom

    col = encoded(spark, sf_dir, "part", "p_partkey", "p_name")
    mine = custom(Contains("ring").automaton(col.dictionary, "online"))(col.tokens)
    return col.df.filter(mine & ~Equals("red ring").tokens(col.tokens, col.dictionary)).select("p_partkey")


@query("SELECT doc_id, text FROM documents")
def roundtrip(spark, sf_dir):
    """decode(encode(x)) is x."""
    return encoded(spark, sf_dir, "documents", "doc_id", "text", TrainingConfig(bits=16)).decompress_all("text")


@query("SELECT event_id, props FROM events")
def roundtrip_native(spark, sf_dir):
    """Decoding by array functions alone, for small dictionaries."""
    return encoded(spark, sf_dir, "events", "event_id", "props", TrainingConfig(bits=9)).decompress_all("props", native=True)


@query("SELECT vec_id, label FROM embeddings")
def roundtrip_fixed_threshold(spark, sf_dir):
    """A column of decimal strings under a fixed merge count."""
    df = read(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("v"))
    col = encode_column(df, "vec_id", "v", TrainingConfig(bits=9, threshold=FixedThreshold(2)))
    return col.decompress_all("v").select("vec_id", F.col("v").cast("int").alias("label"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77")
def decompress_point(spark, sf_dir):
    """One value by key."""
    return encoded(spark, sf_dir, "customer", "c_custkey", "c_name").decompress(77, "c_name")


@query("SELECT doc_id, text, coalesce(CAST(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS \"offset\" FROM documents")
def decompress_all_offsets(spark, sf_dir):
    """All values with their byte offsets in key order."""
    return encoded(spark, sf_dir, "documents", "doc_id", "text").decompress_offsets("text")


@query("SELECT count(*) AS num_strings, CAST(sum(strlen(p_name)) AS BIGINT) AS raw_bytes, true AS sizes_add_up FROM part")
def column_stats(spark, sf_dir):
    """Counts of the encoded column; its sizes follow from bits, tokens and rows."""
    col = encoded(spark, sf_dir, "part", "p_partkey", "p_name")
    raw = col.decompress_all("v").agg(F.sum(F.octet_length("v")).alias("raw_bytes"))
    ok = (F.col("store_bytes") == F.ceil(F.col("num_tokens") * 12 / 8) + 4 * (F.col("num_strings") + 1)) & (F.col("bytes_used") == F.col("store_bytes") + F.col("dict_bytes"))
    return col.stats().crossJoin(F.broadcast(raw)).select("num_strings", "raw_bytes", ok.alias("sizes_add_up"))  # one row each


@query("SELECT 256 AS single_bytes, true AS sorted, true AS short, true AS fits")
def dictionary_invariants(spark, sf_dir):
    """Single bytes are tokens, tokens are sorted and short, and fit the width."""
    d = encoded(spark, sf_dir, "documents", "doc_id", "text").dictionary.frame(spark)
    rank = F.row_number().over(Window.orderBy("bytes")) - 1  # at most 65,536 rows
    return d.withColumn("rank", rank).agg(
        F.sum((F.col("len") == 1).cast("int")).cast("int").alias("single_bytes"), F.min(F.col("rank") == F.col("token_id")).alias("sorted"),
        (F.max("len") <= 16).alias("short"), (F.count("*") <= 1 << 12).alias("fits"),
    )


@query("SELECT * FROM (VALUES ('', true), ('a', true), ('th', true), ('é', true), ('zzzzzzzzzzzzzzzzzzz', true)) AS t(prefix, agrees)")
def dictionary_prefix_range(spark, sf_dir):
    """The id range of a prefix is that of the tokens that begin with it."""
    d = encoded(spark, sf_dir, "documents", "doc_id", "text").dictionary
    spans = [(p, *(lambda r: (r.begin, r.last))(d.prefix_range(p.encode()))) for p in ("", "a", "th", "é", "z" * 19)]
    wanted = F.broadcast(spark.createDataFrame(spans, "prefix string, lo int, hi int"))
    hits = wanted.join(d.frame(spark), F.startswith(F.col("bytes"), F.col("prefix").cast("binary")), "left").groupBy("prefix", "lo", "hi").agg(F.min("token_id").alias("a"), F.max("token_id").alias("b"))
    return hits.select("prefix", F.when(F.col("a").isNull(), F.col("lo") > F.col("hi")).otherwise((F.col("a") == F.col("lo")) & (F.col("b") == F.col("hi"))).alias("agrees"))


@query("SELECT CAST(sum(strlen(p_name)) AS BIGINT) AS bytes, true AS no_longer FROM part")
def token_iteration(spark, sf_dir):
    """Tokens as rows, joined with the dictionary."""
    col = encoded(spark, sf_dir, "part", "p_partkey", "p_name")
    d = F.broadcast(col.dictionary_frame().select(F.col("token_id").alias("token"), "len"))  # at most 65,536 rows
    return col.token_rows().join(d, "token").agg(F.sum("len").alias("bytes"), (F.count("*") <= F.sum("len")).alias("no_longer"))


@query("SELECT page_id, url FROM pages")
def persist_roundtrip(spark, sf_dir):
    """Save to Parquet, load, decode."""
    path = fresh_path(spark, "column")
    storage.save(encoded(spark, sf_dir, "pages", "page_id", "url"), path)
    return storage.load(spark, path).decompress_all("url")


@query("SELECT page_id FROM pages WHERE starts_with(url, 'https://') AND contains(url, '.com/')")
def persist_scan(spark, sf_dir):
    """Scan a column loaded from Parquet."""
    path = fresh_path(spark, "column")
    storage.save(encoded(spark, sf_dir, "pages", "page_id", "url"), path)
    return storage.load(spark, path).scan(StartsWith("https://") & Contains(".com/"))


@query("SELECT page_id, url FROM pages")
def blob_roundtrip(spark, sf_dir):
    """Pack into blobs, read them back, decode."""
    return blob.from_blobs(blob.to_blobs(encoded(spark, sf_dir, "pages", "page_id", "url")), "page_id").decompress_all("url")


@query("SELECT event_id FROM events WHERE props = '{\"k\": 7}' OR contains(props, '42')")
def stream_filter(spark, sf_dir):
    """A predicate on a stream of the table's files."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).parquet(f"{source}*")  # a glob may be one file or a folder
    path = fresh_path(spark, "stream")
    run = filter_rows(stream, "props", Equals('{"k": 7}') | Contains("42")).select("event_id").writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema("event_id bigint").parquet(f"{path}/out")


@query("SELECT p_brand, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_name, 'ring') GROUP BY p_brand")
def compose_join_aggregate(spark, sf_dir):
    """Composition: matching parts, joined and summed."""
    parts = filter_rows(read(spark, sf_dir, "part"), "p_name", Contains("ring")).select("p_partkey", "p_brand")
    lines = read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT lang, count(*) AS n FROM documents WHERE NOT contains(text, 'the') GROUP BY lang")
def compose_group_by(spark, sf_dir):
    """Composition: counts by language of texts without a word, on tokens."""
    df = read(spark, sf_dir, "documents")
    d = encoded(spark, sf_dir, "documents", "doc_id", "text").dictionary
    return encode_column(df, "doc_id", "text", TrainingConfig(bits=12), d, keep=["lang"]).where(~Contains("the")).groupBy("lang").agg(F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train, encode, scan the tokens with a tree, decode the survivors."""
    col = encoded(spark, sf_dir, "documents", "doc_id", "text", TrainingConfig(bits=12, threshold=DynamicThreshold(0.15)))
    hits = col.where(Contains("the") & ~Contains("license"))
    return EncodedColumn(hits, col.dictionary, "doc_id", col.bits).decompress_all("text")
