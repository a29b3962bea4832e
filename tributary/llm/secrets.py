"""Secret scans with linking of credentials that come in parts (native: DataFrame functions only).

Three kinds of spans are reported for their form alone: ``assign`` (a value assigned to a telling name),
``access`` (an access identifier) and ``hex`` (a long run of hex digits). Two kinds are weak, as ordinary
text holds much that looks like them: ``secret`` (forty characters of base64) and ``endpoint`` (a URL). A weak
candidate is reported only where its complement stands near: a secret within ``RADIUS`` characters of an
access identifier, an endpoint within ``RADIUS`` of such a secret, always in the same scope (text between
blank lines).

Places come from the lengths of what lies between matches and of the matches, added up along a
document; only these numbers are shuffled, no texts. The interval join deals starts to intervals of the
radius; identifiers are merged per interval to the first and last start, which tell exactly whether one
is near, so a document with very many parts makes no pairs.

Defined cases: null text counts as empty; places are in code points, ends exclusive; a null doc_id is
treated like any other; repeated rows each get the same result; extra columns are left alone; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

RADIUS = 400
# The kinds and their forms, in the order in which spans of one start are told apart.
NAMES = ("password", "passwd", "secret", "token", "api")
PATTERNS = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])",
    "endpoint": r"""https?://[^\x00-\x20"'<>]+""",
    "break": r"\n[\x20\t\r]*\n",
}
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "secret", "endpoint")
KEY = ["doc_id", "text_hash", "size"]


def matches(kind: str, value: bool) -> Column:
    """What lies before each match of a kind in ``text``, the match and its value, as lengths, in order."""
    regex, text = F.lit(PATTERNS[kind]), F.col("text")
    lengths = lambda column: F.transform(column, lambda x: F.length(x))
    between = lengths(F.split(text, PATTERNS[kind], -1))
    whole = lengths(F.regexp_extract_all(text, regex, F.lit(0)))
    worth = lengths(F.regexp_extract_all(text, regex, F.lit(2))) if value else whole
    return F.arrays_zip(between.alias("gap"), whole.alias("len"), worth.alias("val"))


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, size, kind, start, end) of the matches of all kinds in ``docs``, from one scan.

    Matches are leftmost and don't overlap. A match that fails on its length is dropped after it has
    taken its place. ``hex`` asks for the length in the pattern: a run of hex digits is one match either way.
    A text is searched for a weak kind only if it can hold an access identifier, which all links need.
    """
    wanted = {k: likely(k) for k in BASE} | {k: F.col("linking") & F.col("text").rlike(PATTERNS[k]) for k in PATTERNS if k not in BASE}
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.when(wanted[k], matches(k, k == "assign")).alias("m")) for k in PATTERNS])
    each = docs.withColumn("linking", likely("access")).select(*KEY, F.explode(found).alias("x"))
    rows = each.filter("x.m is not null").select(*KEY, "x.kind", F.posexplode("x.m").alias("k", "m")).select(*KEY, "kind", "k", "m.*").distinct()
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(Window.partitionBy(*KEY, "kind").orderBy("k"))
    least = F.when(F.col("kind") == "assign", 6).when(F.col("kind") == "access", 20).otherwise(1)
    spans = rows.withColumn("end", end).filter(F.col("val") >= least)
    return spans.select(*KEY, "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def likely(kind: str) -> Column:
    """A quick condition that every text with a match of a base kind meets."""
    text = F.col("text")
    if kind == "assign":
        low = F.lower("text")
        any_name = F.contains(low, F.lit(NAMES[0]))
        for name in NAMES[1:]:
            any_name = any_name | F.contains(low, F.lit(name))
        return any_name & text.rlike(PATTERNS[kind])
    if kind == "access":
        return F.contains("text", F.lit("AKIA")) & text.rlike(r"AKIA[A-Z0-9]{16}")
    return text.rlike(r"[0-9a-f]{24}")


def _near(parts: DataFrame, others: DataFrame, radius: int) -> DataFrame:
    """The parts with one of the others in their scope whose start is at most ``radius`` away."""
    scope = [*KEY, "scope"]
    interval = F.floor(F.col("start") / radius)
    ends = others.groupBy(*scope, interval.alias("interval")).agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    ends = ends.select(*[F.col(c).alias(f"e_{c}") for c in ends.columns])
    around = parts.withColumn("interval", F.explode(F.array(*[interval + d for d in (-1, 0, 1)])))
    # in the same interval any is near; in the one before, the last; in the one after, the first
    same = [F.col(c).eqNullSafe(F.col(f"e_{c}")) for c in [*scope, "interval"]]
    near = F.least(F.abs(F.col("start") - F.col("e_lo")), F.abs(F.col("start") - F.col("e_hi"))) <= radius
    together = (F.floor(F.col("start") / radius) == F.col("e_interval")) | near
    return around.join(ends, [*same, together], "left_semi").drop("interval").distinct()


def linked(spans: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The weak spans that stand near their complement, as ``places`` gives them."""
    parts = spans.filter(F.col("kind").isin("access", "secret", "endpoint", "break"))
    order = Window.partitionBy(*KEY).orderBy("start", F.col("kind") != "break")
    parts = parts.withColumn("scope", F.count(F.when(F.col("kind") == "break", 1)).over(order))
    secrets = _near(parts.filter("kind = 'secret'"), parts.filter("kind = 'access'"), radius)
    endpoints = _near(parts.filter("kind = 'endpoint'"), secrets, radius)
    return secrets.unionByName(endpoints).drop("scope")


def secret_spans(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, size, kind, start, end): every span of every document, each once."""
    spans = cut(places(keyed(documents)))  # numbers only; base, weak and linked spans all come from them
    return spans.filter(F.col("kind").isin(*BASE)).unionByName(linked(spans, radius))


def keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return documents.select("doc_id", F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("size"), text.alias("text"))


def scan(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    written = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    item = F.struct("start", order.alias("o"), written.alias("s"))
    joined = lambda items: F.array_join(F.transform(F.sort_array(items), lambda x: x["s"]), ",")
    found = secret_spans(documents, radius).groupBy(*KEY).agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE],
        joined(F.collect_list(F.when(F.col("kind").isin(*BASE), item))).alias("base"),
        joined(F.collect_list(item)).alias("all"),
    )
    found = found.select(*[F.col(c).alias(f"f_{c}" if c in KEY else c) for c in found.columns])
    rows = keyed(documents).drop("text").join(found, [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in KEY], "left")
    return rows.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("all", F.lit("")).alias("spans"),
    )
