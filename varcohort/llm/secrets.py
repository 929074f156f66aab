"""Operator 3: secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by SHA-256. The ledger holds, for each blob and rule version
that was scanned, the spans found. A run scans only the pairs that the ledger lacks, once for each blob
however many paths hold it, and joins the findings back to all paths.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import all_matches, cut, exists, join_hot


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0
    shortest: int = 0
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"

    def find(self, text: Column) -> Column:
        """Array of (start, end)."""
        found = all_matches(text, self.pattern, self.group)
        if self.shortest:
            found = F.filter(found, lambda m: F.length(m["value"]) >= self.shortest)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


#: Fixed patterns. A run of hex digits or of an access key's characters is maximal, so its least length can
#: stand in the pattern; an assignment's value is tested afterwards, as a failing match must use up its text.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", 1, r"[0-9a-f]{24,}", base=True),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
FOUND = "map<string,array<struct<start:int,end:int>>>"
LEDGER = "blob string, rule string, spans array<struct<start:int,end:int>>"


def with_blobs(versions: DataFrame) -> DataFrame:
    """(path, blob, text), null text as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return versions.select("path", F.sha2(text, 256).alias("blob"), text.alias("text"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, n, found, fresh): spans by rule key for every blob of ``versions`` (path, blob, text), and its number of versions.

    What the ledger (blob, rule, spans) has is taken from it; ``fresh`` lists the rules that were run now.
    Each task hands on one text of a blob, however many versions have it.
    """
    own = versions.groupBy("blob").agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("n"))
    if ledger is None:
        own = own.withColumn("known", F.lit(None).cast(FOUND))
    else:
        past = ledger.dropDuplicates(["blob", "rule"]).groupBy("blob").agg(F.map_from_entries(F.collect_list(F.struct("rule", "spans"))).cast(FOUND).alias("known"))
        own = own.join(past, "blob", "left")
    have = lambda r: F.coalesce(F.map_contains_key(F.col("known"), F.lit(r.key)), F.lit(False))
    pairs = [x for r in rules for x in (F.lit(r.key), F.when(have(r), F.col("known")[r.key]).otherwise(r.find(F.col("text"))))]
    fresh = F.array_compact(F.array(*[F.when(~have(r), F.lit(r.key)) for r in rules]))
    return own.select("blob", "n", F.create_map(*pairs).cast(FOUND).alias("found"), fresh.alias("fresh"))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """The rows (blob, rule, spans) that a run adds to the ledger."""
    return scanned.select("blob", "found", F.explode("fresh").alias("rule")).select("blob", "rule", F.col("found")[F.col("rule")].alias("spans"))


def digest(found: Column, rules: tuple[Rule, ...], base_only: bool) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""

    def named(rank: int, rule: Rule) -> Column:
        return F.transform(found[rule.key], lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(rule.kind), s["start"], s["end"]).alias("text")))

    parts = [named(i, r) for i, r in enumerate(rules) if r.base or not base_only]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["text"]), ",")


def find_secrets(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings of every path, (path, n_<kind> of the base kinds, base_sha256, spans), and the ledger's new rows.

    Null texts are empty and have no finding; a null path keeps its row; repeated rows give repeated results, an
    empty table none; further columns of ``versions`` are ignored. The blobs' findings are written to the shared
    folder once; the versions of hot blobs meet them in parts.
    """
    seen = with_blobs(versions)
    scanned = cut(scan(seen, ledger, rules), "findings")
    counts = [F.size(F.col("found")[r.key]).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    digests = scanned.select("blob", *counts, F.sha2(digest(F.col("found"), rules, True), 256).alias("base_sha256"), digest(F.col("found"), rules, False).alias("spans"))
    return join_hot(seen.select("path", "blob"), digests, "blob", scanned.select("blob", "n")).drop("blob"), ledger_rows(scanned)


def scan_into(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of every path, as ``find_secrets`` gives them, with the ledger at ``path``: read where there is one, and added to.

    Rows are added before the findings are given out; a run that fails adds none, and what two runs add at once counts once.
    """
    spark = versions.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(path) if exists(spark, path) else None
    found, new = find_secrets(versions, ledger, rules)
    new.write.mode("append").parquet(path)
    return found


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars`` of the new text.

    Each blob is scanned once; documents without secrets stay as they are, null texts included.
    """
    columns = docs.columns
    keyed = docs.withColumn("__blob", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    scanned = scan(with_blobs(docs.select(F.col("doc_id").alias("path"), "text")), None, rules)
    scanned = cut(scanned.select("blob", "n", "found"), "scanned")
    spans = F.array_sort(F.flatten(F.map_values("found")))
    bad = scanned.select(F.col("blob").alias("__blob"), spans.alias("__spans")).where(F.size("__spans") > 0)
    joined = join_hot(keyed, bad, "__blob", scanned.select(F.col("blob").alias("__blob"), "n"), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        new = F.struct(s["end"].alias("at"), F.concat(acc["text"], gap, F.lit(mark)).alias("text"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["text"].alias("text"))
        return F.when(s["start"] >= acc["at"], new).otherwise(inside)

    clean = F.aggregate(F.col("__spans"), start, step, lambda a: F.concat(a["text"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(clean)
    out = joined.withColumn("text", text)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns)
