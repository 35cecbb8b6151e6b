"""Secret scans that link the parts of a credential.

Base spans are strong by themselves: assignments to password-like names, access key ids and
long hexadecimal runs. Weak candidates are long mixed runs, client identifiers and endpoint
addresses; alone they mean nothing. They are reported only if their complements stand within
``SCOPE`` code points: an identifier for a secret, a secret for an identifier, both for an
endpoint. That interval join is a running maximum over a document's spans in order of position
and a running minimum in the opposite order; each row adds itself to the one before, so the work
is a few sorts of the spans.

Everything is DataFrame functions. Texts are read once; what is shuffled is one row for a
document and one for each span, by a row number, so no document, however its id repeats,
shares a group with another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import table

SCOPE = 200
MASK = "[SECRET]"

# The patterns of base spans, and the least length of an assigned value.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
#: The runs end where their characters end, so the least lengths can stand in the patterns.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

# Weak candidates: (kind, pattern).
SECRET = r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}={0,2}"
IDENTIFIER = r"""(?i)\b(?:client|account|access|user)[_-]?(?:id|key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""
#: Host names begin where their characters begin, so a run of them is looked at once.
ENDPOINT = r"""(?i)\bhttps?://[^\s"'<>]{4,}|(?<![a-z0-9.-])[a-z0-9-][a-z0-9.-]*\.amazonaws\.com\b"""

PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "secret": SECRET, "identifier": IDENTIFIER, "endpoint": ENDPOINT}
BASE = ("assign", "access", "hex")


def _found(text: Column, every: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, place among the matches, length of what stands before, length, whether it holds)."""
    between = F.when(F.size(every) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))
    long_enough = (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST) if pattern == ASSIGN else (lambda m: F.lit(True))
    return F.filter(
        F.transform(
            F.arrays_zip(every.alias("m"), between.alias("b")),
            lambda z, i: F.struct(
                F.lit(kind).alias("kind"), i.alias("at"), F.length(z["b"]).alias("gap"), F.length(z["m"]).alias("size"), long_enough(z["m"]).alias("holds")
            ),
        ),
        lambda f: f["size"].isNotNull(),
    )


def find_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", scope: int = SCOPE, into: str = "spans") -> DataFrame:
    """The columns ``keep`` and ``into``: (start, stop, kind, name), in order of start and kind.

    Starts count code points, stops are exclusive, kinds are those of ``PATTERNS`` in that
    order. Null and empty texts have no spans. Repeated rows stay separate rows. Columns that
    are not kept may have any names; ``into`` must be new among the kept ones.
    """
    if into in keep:
        raise ValueError(f"column {into} exists")
    every = [F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m{k}") for k, p in enumerate(PATTERNS.values())]
    found = [_found(F.col("text"), F.col(f"m{k}"), k, p) for k, p in enumerate(PATTERNS.values())]
    rows = (
        docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        .select("doc", "text", *every)
        .select("doc", F.concat(*found).alias("found"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc", F.posexplode_outer("found").alias("n", "f"))
        .select("row", F.when(F.coalesce("n", F.lit(0)) == 0, F.col("doc")).alias("doc"), "f.*")
        .repartition("row")
    )
    in_kind = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(in_kind))
        .withColumn("start", F.col("stop") - F.col("size"))
        .withColumn("holds", F.coalesce("holds", F.lit(False)))
    )
    by_row, others = Window.partitionBy("row"), (Window.unboundedPreceding, -1)
    before = by_row.orderBy("start", "kind").rowsBetween(*others)
    after = by_row.orderBy(F.desc("start"), F.desc("kind")).rowsBetween(*others)

    def of(*kinds: str) -> Column:
        numbers = [list(PATTERNS).index(k) for k in kinds]
        return F.col("holds") & F.col("kind").isin(numbers)

    def overlaps(which: Column) -> Column:
        earlier = F.max(F.when(which, F.col("stop"))).over(before) > F.col("start")
        later = F.min(F.when(which, F.col("start"))).over(after) < F.col("stop")
        return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))

    def near(which: Column) -> Column:
        earlier = F.col("start") - F.max(F.when(which, F.col("stop"))).over(before) <= scope
        later = F.min(F.when(which, F.col("start"))).over(after) - F.col("stop") <= scope
        return F.coalesce(earlier, F.lit(False)) | F.coalesce(later, F.lit(False))

    base = of(*BASE)
    free = placed.withColumn("hidden", F.col("holds") & ~base & overlaps(base)).withColumn("holds", F.col("holds") & ~F.col("hidden"))
    identifiers, secrets = of("access", "identifier"), of("assign", "hex", "secret")
    linked = (of("secret") & near(identifiers)) | (of("identifier") & near(secrets)) | (of("endpoint") & near(identifiers) & near(secrets))
    kinds = F.array(*map(F.lit, PATTERNS))
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), F.col("kind"), F.element_at(kinds, F.col("kind") + 1).alias("name"))
    return (
        free.withColumn("reported", base | linked)
        .groupBy("row")
        .agg(F.first("doc", ignorenulls=True).alias("doc"), F.array_sort(F.collect_list(F.when(F.col("reported"), span))).alias("found"))
        .select("doc.*", F.col("found").alias(into))
    )


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["stop"])), ",")


def count_of(spans: Column, kind: int) -> Column:
    """How many spans are of a kind. A second parameter of the function would be taken for the place in the array."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """Text with every span, and spans that overlap as one, replaced by ``mask``."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    end = F.aggregate(
        spans,
        start,
        lambda a, s: F.when(
            s["start"] >= a["end"],
            F.struct(F.concat(a["out"], F.substring(text, a["end"] + 1, s["start"] - a["end"]), F.lit(mask)).alias("out"), s["stop"].alias("end")),
        ).otherwise(F.struct(a["out"].alias("out"), F.greatest(a["end"], s["stop"]).alias("end"))),
    )
    rest = F.substring(text, end["end"] + 1, F.length(text))
    return F.when(F.size(spans) > 0, F.concat(end["out"], rest)).otherwise(text)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of each document's base spans, and all reported spans; null texts have none."""
    found = find_secrets(table(spark, sf_dir, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return found.select(
        "doc_id",
        *[count_of(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
