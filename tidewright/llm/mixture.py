"""Mixing sources to target weights.

Method: hierarchical budgeting. Weights go down a tree of domains, sources and
the languages within a source; a node whose documents cannot fill its budget
(each may be taken ``max_repeats`` times) passes the shortage to its siblings,
and only what they cannot take goes up to the parent's siblings. Each leaf then
takes a prefix, in tokens, of seeded epochs: whole passes over its documents,
each in its own seeded order, and a part of the last one.

Sources stand in the domains that a column ``domain`` of the targets names, or
all in one. The targets are set on sources, so languages stand below sources here: a
shortage in one language of a source is made up by its other languages first,
and the source keeps its share.

Distribution: the tree has one node for each source and language and lives on
the driver. Prefixes are found in two steps: token sums of hash ranges of each
leaf, then a running sum inside the one range where the budget ends. There are
as many ranges as the square root of the largest leaf's documents (1,024 to
4,194,304), so neither the ranges of a leaf nor the documents of a range grow
to what one task cannot order.

Defined results: documents of unlisted or null sources and documents without
tokens are never taken; a listed source without documents gets nothing and its
share goes to its siblings; null languages form one language; equal documents
count each; no documents at all give an empty mixture and shares of null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewright.functions.names import source_name, squeezed
from tidewright.llm.bpe import VOCABULARY, token_counts
from tidewright.session import stage

#: Binary logarithms of the fewest and the most hash ranges of a leaf.
RANGES = (10, 22)

#: Leaves of the tree: more sources times languages than this is no register of sources.
LEAVES = 100_000


@dataclass
class Node:
    """A node of the budget tree; ``capacity`` is set on leaves only."""

    name: str
    weight: float
    children: list["Node"] = field(default_factory=list)
    capacity: float = 0.0
    budget: float = 0.0

    def room(self) -> float:
        return sum(c.room() for c in self.children) if self.children else self.capacity

    def give(self, amount: float) -> float:
        """Spend up to ``amount`` below this node, siblings first; returns what it could not take."""
        self.budget += amount
        if not self.children:
            left = max(0.0, self.budget - self.capacity)
            self.budget -= left
            return left
        open_ = [c for c in self.children if c.weight > 0 and c.room() - c.budget > 1e-9]
        left = amount
        while left > 1e-6 and open_:
            total = sum(c.weight for c in open_)
            left = sum(c.give(left * c.weight / total) for c in open_)
            open_ = [c for c in open_ if c.room() - c.budget > 1e-9]
        self.budget -= left
        return left


def language(c: Column) -> Column:
    """The primary part of a language tag; none is ``und``."""
    return F.coalesce(F.nullif(F.regexp_extract(squeezed(c), r"^[a-z]+", 0), F.lit("")), F.lit("und"))


@dataclass
class Plan:
    total: float
    leaves: list[tuple[str, str, float, float, int]]  # source, language, available, budget, repeats
    targets: dict[str, tuple[float, int]]
    largest: int = 0  # documents of the largest leaf

    def range_bits(self) -> int:
        return min(max((self.largest.bit_length() + 1) // 2, RANGES[0]), RANGES[1])


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang and n_tokens of each document, staged: four narrow columns.

    Tokens are counted in one pass over the texts that carries source and
    language as part of the key, so no join brings them back.
    """
    key = F.struct("doc_id", source_name(F.col("source")).alias("s"), language(F.col("lang")).alias("l"))
    tagged = documents.select(key.alias("doc_id"), "text")
    from tidewright.llm import bpe

    counts = tagged.mapInArrow(bpe._encoder(bpe.read_ranks(vocabulary), True), "doc_id struct<doc_id: long, s: string, l: string>, n_tokens long")
    return stage(counts.select("doc_id.doc_id", F.col("doc_id.s").alias("source"), F.col("doc_id.l").alias("lang"), "n_tokens"))


def plan(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, domains: dict[str, str] | None = None) -> Plan:
    """Budgets of all leaves.

    Without ``total_tokens`` the mixture is as large as it can be with every
    source that has documents still reaching its share. ``domains`` (by the
    source's name) goes before a column ``domain`` of the targets.
    """
    domain = F.min("domain") if "domain" in targets.columns else F.lit(None).cast("string")
    listed = targets.groupBy(source_name(F.col("source")).alias("s")).agg(F.sum("target_share"), F.max("max_repeats"), domain).where("s is not null and s <> ''").limit(LEAVES + 1).collect()
    if len(listed) > LEAVES:
        raise ValueError(f"more than {LEAVES} sources")
    wanted = {r[0]: (float(r[1] or 0.0), int(r[2] or 0)) for r in listed}
    domains = {r[0]: r[3] for r in listed if r[3] is not None} | (domains or {})
    have = docs.where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0)).groupBy("source", "lang").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"))
    got = have.limit(LEAVES + 1).collect()
    if len(got) > LEAVES:
        raise ValueError(f"more than {LEAVES} languages of sources")
    by: dict[str, list[tuple[str, float]]] = {}
    for s, lang, t, _ in sorted(got):
        by.setdefault(s, []).append((lang, float(t)))
    room = {s: sum(t for _, t in ls) * wanted[s][1] for s, ls in by.items()}
    live = [s for s in by if wanted[s][0] > 0 and room[s] > 0]
    if total_tokens is None:
        total_tokens = min((room[s] / wanted[s][0] for s in live), default=0.0)
    roots: dict[str, Node] = {}
    leaves: list[tuple[str, str, float, int, Node]] = []
    for s, (share, repeats) in sorted(wanted.items()):
        top = roots.setdefault(domains.get(s, "all"), Node(domains.get(s, "all"), 0.0))
        node = Node(s, share)
        top.weight += share
        top.children.append(node)
        mine = sum(t for _, t in by.get(s, []))
        for lang, t in by.get(s, []):
            leaf = Node(lang, t / mine, capacity=t * repeats)
            node.children.append(leaf)
            leaves.append((s, lang, t, repeats, leaf))
    Node("corpus", 1.0, list(roots.values())).give(total_tokens)
    return Plan(total_tokens, [(s, lang, t, leaf.budget, r) for s, lang, t, r, leaf in leaves], wanted, max((r[3] for r in got), default=0))


def mixture(docs: DataFrame, made: Plan, seed: int = 7) -> DataFrame:
    """doc_id, source, lang, epoch, n_tokens: one row each time a document is taken."""
    spark = docs.sparkSession
    rows = []
    for s, lang, available, budget, repeats in made.leaves:
        whole = min(repeats, int((budget + 0.5) // available)) if available else 0
        rest = max(0.0, budget - whole * available) if whole < repeats else 0.0
        rows.append((s, lang, whole, float(rest)))
    # one row for each source and language, bounded by LEAVES
    leaf = F.broadcast(spark.createDataFrame(rows, "source string, lang string, whole int, rest double"))
    d = docs.where("n_tokens > 0").join(leaf, ["source", "lang"])
    d = d.withColumn("_h", F.xxhash64(F.lit(seed), F.col("whole"), F.col("doc_id"))).withColumn("_r", F.shiftrightunsigned("_h", 64 - made.range_bits()))
    sums = d.where("rest > 0").groupBy("source", "lang", "_r").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source", "lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = sums.withColumn("_before", before).select("source", "lang", "_r", "_before", "t")
    # at most 2 ** range_bits rows for each leaf
    d = d.join(edges, ["source", "lang", "_r"], "left")
    inside = F.col("_before").isNotNull() & (F.col("_before") + F.col("t") <= F.col("rest"))
    edge = F.col("_before").isNotNull() & (F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("t") > F.col("rest"))
    at_edge = d.where(edge)
    run = F.sum("n_tokens").over(Window.partitionBy("source", "lang").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = at_edge.withColumn("_cum", F.col("_before") + run).where(F.col("_cum") - F.col("n_tokens") / 2 <= F.col("rest"))
    cols = ("doc_id", "source", "lang", "n_tokens")
    passes = d.where("whole > 0").select(*cols, F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("epoch"))
    last = d.where(inside).select(*cols, F.col("whole").alias("epoch")).unionByName(taken.select(*cols, F.col("whole").alias("epoch")))
    return passes.unionByName(last).select("doc_id", "source", "lang", "epoch", "n_tokens")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7, total_tokens: float | None = None, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of ``documents`` for ``targets``, which may have a column ``domain``."""
    docs = sized(documents, vocabulary)
    made = plan(docs, targets, total_tokens, domains)
    mixed = mixture(docs, made, seed)
    return mixed, shares(mixed, docs, made)


def shares(mixed: DataFrame, docs: DataFrame, made: Plan) -> DataFrame:
    """Target and reached share of each listed source, with its sizes and most repeats."""
    spark = docs.sparkSession
    t = F.broadcast(spark.createDataFrame([(s, w, r) for s, (w, r) in made.targets.items()], "source string, target_share double, max_repeats int"))
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").cast("int").alias("times"))
    took = per_doc.groupBy("source").agg(F.sum("t").alias("taken_tokens"), F.count("*").alias("taken_documents"), F.max("times").alias("most_repeats"))
    have = docs.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("documents"))
    out = t.join(have, "source", "left").join(took, "source", "left").na.fill(0, ["available_tokens", "documents", "taken_tokens", "taken_documents", "most_repeats"])
    total = F.sum("taken_tokens").over(Window.partitionBy(F.lit(1)))  # one row for each listed source
    return out.withColumn("reached_share", F.when(total > 0, F.col("taken_tokens") / total))
