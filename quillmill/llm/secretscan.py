"""Secret scans with an incremental ledger of blobs, in DataFrame operations only.

Every version of every document is addressed by its content's SHA-256. The ledger records which (blob, rule,
rule version) were scanned and what they gave; a run scans only the pairs that it lacks, each blob once however
many paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import save


@dataclass(frozen=True)
class Rule:
    """kind and version name the rule; a match counts if ``group`` has ``least`` characters or more.

    ``sign`` is a cheaper pattern that every text with a match has.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    sign: str


#: In the order in which kinds of equal start are listed.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, r"(?i)(?:passw|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12}"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32, r"[0-9a-f]{32}"),
    Rule("private", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, r"eyJ[A-Za-z0-9_-]{8}"),
)
BASE = ("assign", "access", "hex")
#: Matches of a text that are summed in one run.
RUN = 256
_SPANS = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """start and end (code points, end exclusive) of the rule's leftmost non-overlapping matches that count.

    The pieces between matches and the matches themselves alternate, so running lengths give the offsets.
    """
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(F.slice(pieces, 1, F.size(whole)), F.arrays_zip(whole.alias("w"), part.alias("p")), lambda a, m: F.struct(F.length(a).alias("skip"), F.length(m["w"]).alias("len"), (F.length(m["p"]) >= rule.least).alias("good")))
    # Running sums append to an array, which costs its length each time: runs of RUN matches are summed apart.
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")), lambda i: F.slice(steps, i * RUN + 1, RUN))
    runs = F.when(F.size(steps) > 0, runs).otherwise(F.array())
    width = lambda run: F.aggregate(run, F.lit(0), lambda n, s: n + s["skip"] + s["len"])
    offsets = F.aggregate(runs, F.array(F.lit(0)), lambda acc, run: F.concat(acc, F.array(F.element_at(acc, -1) + width(run))))

    def placed(run: Column, offset: Column) -> Column:
        zero = F.struct(offset.alias("at"), F.array().cast(_SPANS).alias("out"))

        def add(acc, s):
            start = acc["at"] + s["skip"]
            end = start + s["len"]
            one = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(s["good"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        return F.aggregate(run, zero, add, lambda acc: acc["out"])

    found = F.flatten(F.zip_with(runs, F.slice(offsets, 1, F.size(runs)), placed))
    return F.when(text.rlike(rule.sign), found).otherwise(F.array().cast(_SPANS))


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Brings the ledger at a shared path up to date; returns (paths, ledger rows).

    Two runs that overlap in time may both add a pair; their rows are equal, and the returned ledger has each once.

    paths: doc_id, blob of every row (null texts count as empty). Ledger rows: blob, kind, version, spans, one
    for each pair scanned so far. Only pairs that the ledger lacks are scanned, in texts of one path of each
    blob; a rule of a new version is a new pair, and older ones stay. An empty table adds nothing; repeated
    rows are paths of one blob; columns other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths = save(docs.select("doc_id", "blob"), "secrets-paths")
    known = _exists(spark, ledger)
    schema = f"blob string, kind string, version int, spans {_SPANS}"
    pairs = F.explode(F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules)))
    blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    wanted = blobs.select("blob", "doc_id", pairs.alias("_r")).select("blob", "doc_id", "_r.kind", "_r.version")
    if known:
        wanted = wanted.join(spark.read.schema(schema).parquet(ledger).select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
    wanted = wanted.groupBy("blob", "doc_id").agg(F.collect_set("kind").alias("_kinds")).select(F.col("blob").alias("_b"), F.col("doc_id").alias("_d"), "_kinds")
    texts = docs.join(wanted, (F.col("blob") == F.col("_b")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    per_rule = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("_kinds", r.kind), spans(F.col("text"), r)).alias("spans")) for r in rules))
    found = texts.select("blob", F.explode(per_rule).alias("_f")).select("blob", "_f.*").where("spans is not null")
    # Rows repeated with the same id give the same pair twice.
    found.dropDuplicates(["blob", "kind", "version"]).write.mode("append").parquet(ledger)
    return paths, spark.read.schema(schema).parquet(ledger).dropDuplicates(["blob", "kind", "version"])


def join_paths(paths: DataFrame, rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and found (start, rank, kind, end; in order of start, then rule) of every path."""
    current = F.array(*(F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules))
    rank = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))))
    rows = rows.where((F.size("spans") > 0) & F.array_contains(current, F.struct("kind", "version")))
    listed = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, F.col("kind")).alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end")))
    by_blob = rows.select("blob", listed.alias("_l")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("_l"))).alias("found"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return paths.join(by_blob, "blob", "left").select("doc_id", "blob", F.coalesce("found", empty).alias("found"))
