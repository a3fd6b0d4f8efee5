"""Secret scanning with multipart credential linking, in SQL expressions alone.

Base spans are regex matches of three kinds.  Offsets come from splitting the
text by the pattern: the lengths of the pieces and of the matches, added up in
order, are the positions in code points.

Parts too weak to report alone are collected as well: user and key identifiers,
assignments with short values, and endpoints.  An interval join inside each
document's scopes then reports a weak part only where complementary parts lie
within ``scope`` code points:

* ``weak_id``      an identifier, beside any secret;
* ``weak_secret``  a short assigned value, beside any identifier;
* ``endpoint``     a URL or address, beside both an identifier and a secret.

Identifiers are ``access`` and ``weak_id``; secrets are ``assign``, ``hex`` and
``weak_secret``.  The join is an equi-join on (row, position bucket) with a range
condition; a weak part is listed in the buckets of its whole span,
the others in those that their scope touches, so the work
grows with the text, not with the square of the parts.

Defined results: a null text counts as empty and has no spans.  Long texts are
scanned whole; their positions are added up in blocks.  Spans that start together
are ordered by kind.  Repeated rows are scanned each; an empty table gives no
rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stringloom.llm.common import checkpoint, maybe_broadcast

#: Kind -> pattern; a match stands if KEEP holds for it. Matches do not overlap within a kind.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "weak_id": r"""(?:(?i)(?:user_?name|user_?id|login|account_?id|client_?id|access_?key_?id|access_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,})|(?<![A-Z0-9])AKIA[A-Z0-9]{4,13}(?![A-Z0-9])""",
    "endpoint": r"""(?i)(?:https?|ftps?|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[A-Za-z0-9._:@/?=&%+~-]{3,}|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])""",
}
#: All kinds in the order that breaks ties of start.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
BASE = KINDS[:3]
ROLE = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "id", "weak_id": "id", "endpoint": "place"}
SCOPE = 200
SPAN = "array<struct<s:bigint,e:bigint,m:string>>"


#: Matches whose positions are added up at a time; more make blocks, so that no array grows by its whole length match by match.
BLOCK = 512


def _running(sizes: Column) -> Column:
    """(sum before, sum with) of every element of an array of longs."""
    pair = "array<struct<a:bigint,b:bigint>>"

    def step(acc: Column, n: Column) -> Column:
        e = acc["at"] + n
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("a"), e.alias("b")))).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(pair).alias("out"))
    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def _matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, matched text), found left to right without overlap."""
    rows = F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())

    def placed(rows: Column, at: Column) -> Column:
        sizes = F.transform(rows, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("bigint"))
        return F.zip_with(rows, _running(sizes), lambda x, r: F.struct((at + r["b"] - F.length(x["hit"])).alias("s"), (at + r["b"]).alias("e"), x["hit"].alias("m")))

    def in_blocks(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))
        total = lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x["gap"]) + F.length(x["hit"]))
        return F.flatten(F.zip_with(blocks, _running(F.transform(blocks, total)), lambda b, r: placed(b, r["a"])))

    found = F.element_at(F.transform(F.array(rows), in_blocks), 1)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(SPAN))


def candidates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, value: int = 12) -> DataFrame:
    """row, doc_id, text hash and one array of spans per kind, strong and weak."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("sig"), *(_matches(t, p).alias(k) for k, p in PATTERNS.items()))
    size = lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2))
    bare = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    return df.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "sig",
        bare(F.filter("assign", lambda x: size(x) >= value)).alias("assign"), bare("access").alias("access"), bare("hex").alias("hex"),
        bare("weak_id").alias("weak_id"), bare(F.filter("assign", lambda x: size(x) < value)).alias("weak_secret"), bare("endpoint").alias("endpoint"),
    )


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, s, e) of the weak parts whose complementary parts lie in scope."""
    some = lambda *kinds: sum((F.size(k) for k in kinds), F.lit(0)) > 0
    rows = found.filter(some("assign", "hex", "weak_secret") & some("access", "weak_id") & some("weak_id", "weak_secret", "endpoint"))
    part = lambda k: F.transform(k, lambda x: F.struct(F.lit(k).alias("kind"), F.lit(ROLE[k]).alias("role"), x["s"].alias("s"), x["e"].alias("e")))
    parts = rows.select("row", F.explode(F.concat(*(part(k) for k in KINDS))).alias("p")).select("row", "p.*")
    weak = parts.filter(F.col("kind").isin("weak_id", "weak_secret", "endpoint")).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("s") / scope), F.floor(F.col("e") / scope))))
    near = parts.filter("role != 'place'").select(
        "row", F.col("role").alias("other"), F.col("s").alias("low"), F.col("e").alias("high"),
        F.explode(F.sequence(F.floor((F.col("s") - scope) / scope), F.floor((F.col("e") + scope) / scope))).alias("bucket"),
    )
    pairs = weak.join(near, ["row", "bucket"]).filter((F.col("e") >= F.col("low") - scope) & (F.col("s") <= F.col("high") + scope))
    has = lambda role: F.max((F.col("other") == role).cast("int")) == 1
    sides = pairs.groupBy("row", "kind", "s", "e").agg(has("secret").alias("secret"), has("id").alias("id"))
    return sides.filter("case kind when 'weak_id' then secret when 'weak_secret' then id else secret and id end").select("row", "kind", "s", "e")


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of (s, k, e) structs by start, then kind, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", name(x), x["s"], x["e"])), ",")


def _scanned(df: DataFrame, doc_id: str, text: str, scope: int) -> DataFrame:
    """doc_id, sig, the base counts, and ``base`` and ``more`` as arrays of (s, k, e)."""
    found = checkpoint(candidates(df, doc_id, text))
    rank = {k: i for i, k in enumerate(KINDS)}
    kind = F.expr("case kind " + " ".join(f"when '{k}' then {i}" for k, i in rank.items()) + " end")
    more = linked(found, scope).select("row", F.struct("s", kind.alias("k"), "e").alias("x")).groupBy("row").agg(F.collect_list("x").alias("more"))
    placed = lambda k: F.transform(k, lambda x: F.struct(x["s"].alias("s"), F.lit(rank[k]).alias("k"), x["e"].alias("e")))
    base = found.select("row", "doc_id", "sig", *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE), F.concat(*(placed(k) for k in BASE)).alias("base"))
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    return base.join(more, "row", "left").withColumn("more", F.coalesce("more", none))


def secret_scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, scope: int = SCOPE) -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` holds base and linked spans as ``kind:start:end``, code points, end exclusive.
    """
    out = _scanned(df, doc_id, text, scope)
    return out.select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "more")).alias("spans"))


def redact(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, scope: int = SCOPE, mask: str = "[secret]") -> DataFrame:
    """``df`` with every span of its texts, overlapping ones as one, replaced by ``mask``; all columns stay.

    The work grows with spans times length in a single text, as each cut counts
    code points from the text's beginning.
    """
    kept = df.columns
    spans = _scanned(df, doc_id, text, scope).select(F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"), F.array_sort(F.concat("base", "more")).alias("__spans"))
    spans = checkpoint(spans.filter(F.size("__spans") > 0).dropDuplicates(["__id", "__sig"]))
    spans = maybe_broadcast(spans, spans.count(), 256)
    same = df[doc_id].eqNullSafe(spans["__id"]) & (F.xxhash64(F.coalesce(df[text], F.lit(""))) == spans["__sig"])
    cut = lambda t, a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["s"] >= acc["at"]
        grown = F.when(fresh, F.concat(acc["out"], F.array(cut(df[text], acc["at"], x["s"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    last = lambda acc: F.array(cut(df[text], acc["at"], F.length(df[text]).cast("bigint")))
    clean = F.aggregate(spans["__spans"], start, step, lambda acc: F.array_join(F.concat(acc["out"], last(acc)), mask))
    out = df.join(spans, same, "left").select(*(F.when(spans["__spans"].isNull(), df[c]).otherwise(clean).alias(c) if c == text else df[c] for c in kept))
    return out
