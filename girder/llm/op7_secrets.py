"""Secret scan by an incremental blob ledger, in DataFrame operations only.

Every version of a document is addressed by its content (SHA-256). The ledger holds the (blob, rule,
rule version) triples scanned so far with what they found; a run scans a blob only under the rules whose
triples the ledger misses, each once however many paths hold it, appends to the ledger, and joins findings
back to all paths. The query takes the table as two commits of a history, told apart by a hash of the id:
the second meets the ledger of the first and scans only blobs that the first did not hold.

Positions come from splitting a text at the matches: pieces and matches alternate, so a running sum of
their lengths in code points, a row a match, gives the spans. Matches are leftmost and don't overlap within
a rule. The method adds no spans to those of the base rules.

The blob's text comes from one row of its blob (its smallest id), picked on the narrow versions table, so
text meets only narrow keys that are spread by id. Findings join back on the blob; a blob with a third
of all paths is split by the adaptive skew join, its findings being one row.

Nulls: a null text counts as empty; a null doc_id is kept as a path of its own. Rows that repeat stay,
each with its findings, and are scanned once. A text without a secret has no spans. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from girder.llm.common import Scratch, is_empty, table


@dataclass(frozen=True)
class Rule:
    """``pattern``: what to find; ``keep``: what a match must also satisfy in full, or None."""

    kind: str
    version: int
    pattern: str
    keep: str | None = None


#: Fixed values of the base rules. A run of word characters is taken whole, so a length bound inside the
#: pattern drops the same matches as one after it; for assignments it would not, and follows.
RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?s)^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)


SPANS = "array<struct<start:int,end:int>>"


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, ok>>: for each match the code points before it since the last one, its own, and whether it is kept."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(found.alias("m"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    return F.transform(pairs, lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"), (x["m"].rlike(rule.keep) if rule.keep else F.lit(True)).alias("ok")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...], scratch: Scratch, name: str) -> DataFrame:
    """The ledger's rows for blobs (blob, text, kinds), each under its ``kinds`` of rules; no spans: scanned, nothing found."""
    none = F.array().cast("array<struct<gap:int,size:int,ok:boolean>>")

    def scanned(r: Rule) -> Column:
        hit = F.when(F.col("text").rlike(r.pattern), _matches(F.col("text"), r)).otherwise(none)
        return F.when(F.array_contains("kinds", r.kind), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), hit.alias("hits")))

    rows = blobs.select("blob", F.explode(F.array(*map(scanned, rules))).alias("x")).where("x is not null").select("blob", "x.kind", "x.version", "x.hits")
    rows = scratch.save(rows, f"{name}-hits")
    each = rows.where(F.size("hits") > 0).select("blob", "kind", "version", F.posexplode("hits").alias("i", "hit"))
    end = F.sum(F.col("hit.gap") + F.col("hit.size")).over(W.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    each = each.withColumn("end", end.cast("int"))
    span = F.when(F.col("hit.ok"), F.struct((F.col("end") - F.col("hit.size")).alias("start"), "end"))
    some = each.groupBy("blob", "kind", "version").agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))
    bare = rows.where(F.size("hits") == 0).select("blob", "kind", "version", F.array().cast(SPANS).alias("spans"))
    return scratch.save(some.union(bare), name)


def scan_versions(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The versions (doc_id, blob), the findings of all their blobs and of the ledger's, and the new rows of the ledger."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "op7")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("__id"), text.alias("__text"), F.sha2(text.cast("binary"), 256).alias("__blob"))
    versions = scratch.save(docs.select(F.col("__id").alias("doc_id"), F.col("__blob").alias("blob")), "versions")
    # the head of a blob: its smallest id, and how many rows are equal to it
    heads = versions.groupBy("blob", "doc_id").agg(F.count("*").alias("n")).groupBy("blob").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("h"))
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    wanted = heads.select(F.col("blob").alias("__b"), F.col("h.doc_id").alias("__head"), (F.col("h.n") > 1).alias("__many"), F.explode(kinds).alias("r")).select("*", "r.kind", "r.version")
    if ledger is not None:
        known = ledger.select(F.col("blob").alias("__b"), "kind", "version")
        wanted = wanted.join(known, ["__b", "kind", "version"], "left_anti")
    wanted = scratch.save(wanted.groupBy("__b", "__head", "__many").agg(F.collect_set("kind").alias("kinds")), "wanted")
    unseen = docs.join(wanted, F.col("__id").eqNullSafe(F.col("__head")) & (F.col("__blob") == F.col("__b")))
    if not is_empty(wanted.where("__many")):
        unseen = unseen.where(~F.col("__many")).union(unseen.where("__many").dropDuplicates(["__blob"]))
    fresh = scan_blobs(unseen.select(F.col("__blob").alias("blob"), F.col("__text").alias("text"), "kinds"), rules, scratch, "ledger-new")
    if ledger is None:
        return versions, fresh, fresh
    # the ledger keeps findings of older rule versions, which don't count
    asked = F.array_contains(kinds, F.struct("kind", "version"))
    return versions, fresh.unionByName(ledger.select("blob", "kind", "version", "spans").where(asked)), fresh


def findings_by_path(versions: DataFrame, findings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found): each path with the spans of its blob as array<struct<start, rank, kind, end>>, in order."""
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    hits = findings.where(F.size("spans") > 0).select("blob", "kind", "version", F.explode("spans").alias("s")).select("blob", F.struct(F.col("s.start").alias("start"), rank[F.col("kind")].alias("rank"), "kind", F.col("s.end").alias("end")).alias("f"))
    hits = hits.groupBy(F.col("blob").alias("__b")).agg(F.array_sort(F.collect_set("f")).alias("found"))
    none = F.array().cast(hits.schema["found"].dataType)
    return versions.join(hits, F.col("blob") == F.col("__b"), "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    early = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) < 2**31, F.lit(True))
    before, _, ledger = scan_versions(docs.where(early))
    after, findings, _ = scan_versions(docs.where(~early), ledger=ledger)
    paths = findings_by_path(before.union(after), findings)
    joined = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return paths.select("doc_id", *[count(r.kind) for r in RULES], F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def _sql_spans(kind: str, rank: int, pattern: str, keep: str) -> str:
    quoted = pattern.replace("'", "''")
    kept = keep.replace("'", "''")
    return f"""
  SELECT doc_id, n, '{kind}' AS kind, {rank} AS rank, u.i,
         list_sum(list_transform(g[1:u.i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:u.i - 1], lambda x: length(x))), 0)::BIGINT AS s,
         length(m[u.i]) AS len, m[u.i] AS hit
  FROM (SELECT doc_id, n, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS g FROM d), unnest(range(1, len(m) + 1)) u(i)
  WHERE regexp_matches(m[u.i], '{kept}')"""


_ANY = r"(?s)^.*$"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS n FROM documents),
f AS ({" UNION ALL ".join(_sql_spans(r.kind, i, r.pattern, r.keep or _ANY) for i, r in enumerate(RULES))}),
a AS (
  SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || (s + len), ',' ORDER BY s, rank) AS spans
  FROM f GROUP BY n
)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)
"""
