"""A mixture of sources that meets target weights, each record repeated at most a capped number of times.

Budgets run down a tree of weights: domain, language, source (``plan``; ``Budget`` takes any depth).  A
node hands its budget to its
children in proportion to their weights; a child that can't use its part, because its records times
their allowed uses are fewer, takes what it can, and the rest goes to its siblings in proportion
again, before any of it returns to the level above.  Each leaf then fills its budget with whole
epochs over its records and a prefix of one more epoch, in an order seeded per epoch, so the choice is
repeatable and independent of how the data lies.

The prefix of a leaf is found through sums over ranges of the order, so no leaf is sorted in one task.

Sizes are tokens of a public byte-level BPE whose file is a parameter.

Defined results: null and empty texts have no tokens; records whose source is null or not in the
targets take no part; targets of one source spelled twice add up, with the larger cap; a source
without records has nothing to give and is short if its share is above zero; null or negative shares
and caps count as zero; an empty corpus is short of nothing, as its total is zero; other columns are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rootline.functions.labels import label
from rootline.session import materialize

#: File of the tokenizer: lines of a base64 token and its rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How the tokenizer cuts a text before merging (a fixed value that belongs to the file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Leaves of the tree of weights, which is kept on the driver.
MAX_LEAVES = 100_000

#: Share of a budget that rounding may cost.
ROUNDING = 1e-9

#: Ranges that the order of a leaf is cut into to find its prefix.
RANGES = 4096

#: Counts that a task remembers, and the longest piece it remembers one for.
CACHE_PIECES, CACHE_LENGTH = 400_000, 48

SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: White space and what follows it up to the next.  The pattern never joins text with white space
#: behind it, so the counts of these pieces add up to the count of the text.
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

_counters: dict[str, TokenCounter] = {}


class TokenCounter:
    """Counts the tokens of texts; pieces that come again are counted once."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._known: dict[str, int] = {}

    @classmethod
    def of(cls, path: str) -> TokenCounter:
        """The counter of this process for a file."""
        if path not in _counters:
            _counters[path] = cls(path)
        return _counters[path]

    def count(self, text: str | None) -> int:
        """The number of tokens of a text."""
        if not text:
            return 0
        pieces, known = PIECE.findall(text), self._known
        try:
            return sum(map(known.__getitem__, pieces))
        except KeyError:
            pass
        total = 0
        for piece in pieces:
            n = known.get(piece)
            if n is None:
                n = len(self._encode(piece))
                if len(piece) <= CACHE_LENGTH:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[piece] = n
            total += n
        return total


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """(*keep, tokens): the size of each document; the texts go no further than this scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TokenCounter.of(tokenizer).count
        for batch in batches:
            tokens = pa.array([count(t) for t in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], tokens], names=[*keep, "tokens"])

    chosen = documents.select("text", *keep)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{types}, tokens long")


@dataclass
class Budget:
    """A node of the tree of weights: what it may take, what it was given."""

    weight: float = 0.0
    capacity: float = 0.0
    wanted: float = 0.0
    granted: float = 0.0
    children: dict[str, Budget] = field(default_factory=dict)

    def add(self, path: tuple[str, ...], weight: float, capacity: float) -> None:
        """Add a leaf below this node; a node weighs what its leaves weigh."""
        node = self
        for step in (*path, None):
            node.weight += weight
            node.capacity += capacity
            if step is not None:
                node = node.children.setdefault(step, Budget())

    def grant(self, amount: float) -> None:
        """Spread an amount over the subtree: by weight, each child up to its capacity, shortages to
        its siblings."""
        self.granted = min(amount, self.capacity)
        open_, left = {k: c for k, c in self.children.items() if c.weight > 0}, self.granted
        for child in self.children.values():
            child.wanted = self.granted * child.weight / (sum(c.weight for c in open_.values()) or 1)
        shares = dict.fromkeys(self.children, 0.0)
        while open_ and left > 0:
            total = sum(c.weight for c in open_.values())
            full = [k for k, c in open_.items() if c.capacity - shares[k] <= left * c.weight / total]
            if not full:
                for k, c in open_.items():
                    shares[k] += left * c.weight / total
                break
            for k in full:
                left -= open_[k].capacity - shares[k]
                shares[k] = open_.pop(k).capacity
        for k, child in self.children.items():
            child.grant(shares[k])

    def leaves(self, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], Budget]]:
        """The leaves below this node with their paths."""
        if not self.children:
            yield path, self
        for k, child in self.children.items():
            yield from child.leaves((*path, k))


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """{source: (target share, most uses)}; the targets are the leaves of the tree of weights, at
    most ``MAX_LEAVES`` of them."""
    share = F.greatest(F.coalesce(F.nanvl(F.col("target_share").cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    uses = F.greatest(F.coalesce(F.col("max_uses").cast("int"), F.lit(0)), F.lit(0))
    rows = targets.select(label(F.col("source")).alias("source"), share.alias("share"), uses.alias("uses")).where("source is not null").groupBy("source").agg(F.sum("share").alias("share"), F.max("uses").alias("uses")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} targets")
    return {r.source: (r.share, r.uses) for r in sorted(rows)}


def _order(seed: int, epoch: Column) -> Column:
    """The place of a record in the order of an epoch, from 0 to below 2**32."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch, F.col("doc_id")), F.lit(2**32))


def plan(sized: DataFrame, targets: dict[str, tuple[float, int]], total: float | None = None, domains: dict[str, str] | None = None) -> tuple[Budget, DataFrame]:
    """The tree of budgets, and its leaves as rows: domain, lang, source, tokens, target_share,
    capacity, wanted, granted.

    ``sized`` has (source, lang, tokens) per record, sources clean.  The tree is domain, language,
    source; ``domains`` names the domain of a source, the others are in one of their own.  A source
    weighs its share, spread over its languages by what they hold; so what a source can't give goes to
    those of its language and domain first, then within the domain, then to all.  The total is that
    of all records.
    """
    spark = sized.sparkSession
    held: dict[str, dict[str, int]] = {s: {} for s in targets}
    rows = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    for r in sorted(rows, key=lambda r: (r.source, r.lang)):
        held[r.source][r.lang] = r.tokens
    everything = sum(sum(v.values()) for v in held.values())
    asked = float(everything if total is None else total)
    root, leaves = Budget(), []
    for source, (share, uses) in targets.items():
        own = sum(held[source].values())
        for lang, tokens in (held[source] or {"": 0}).items():
            path = ((domains or {}).get(source, ""), lang, source)
            weight = share * (tokens / own if own else 1.0 / max(1, len(held[source])))
            root.add(path, weight, float(tokens * uses))
            leaves.append((path, tokens, share, float(tokens * uses), asked * weight))
    root.grant(asked)
    granted = {path: leaf.granted for path, leaf in root.leaves()}
    out = [(*path, tokens, share, capacity, wanted, granted[path]) for path, tokens, share, capacity, wanted in leaves]
    return root, spark.createDataFrame(out, "domain string, lang string, source string, tokens long, target_share double, capacity double, wanted double, granted double")


def sized_records(documents: DataFrame, targets: dict[str, tuple[float, int]], tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, lang, tokens) of the records whose source is a target, stored."""
    named = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", label(F.col("source")).alias("source"), F.coalesce(F.substring(label(F.col("lang")), 1, 2), F.lit("")).alias("lang"))
    return materialize(token_counts(named.where(F.col("source").isin(list(targets))), tokenizer), "sized")


def choose(sized: DataFrame, leaves: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, lang, tokens, uses): how often each record is used.

    A leaf runs through all its records as often as its budget allows, then takes the records of the
    next epoch in order while the budget lasts, the last one included if it starts within it.
    """
    budget = leaves.where("tokens > 0").select("source", "lang", F.floor(F.col("granted") / F.col("tokens")).cast("int").alias("epochs"), (F.col("granted") - F.floor(F.col("granted") / F.col("tokens")) * F.col("tokens")).alias("rest"))
    placed = sized.join(F.broadcast(budget), ["source", "lang"]).withColumn("at", _order(seed, F.col("epochs"))).withColumn("range", F.floor(F.col("at") / (2**32 // RANGES)).cast("int"))
    sums = placed.groupBy("source", "lang", "range").agg(F.sum("tokens").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("source", "lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_sum")
    ranged = placed.join(ranges, ["source", "lang", "range"])
    inside = F.sum("tokens").over(Window.partitionBy("source", "lang", "range").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1))
    started = F.col("_before") + F.coalesce(inside, F.lit(0)) < F.floor("rest")
    return ranged.withColumn("uses", F.col("epochs") + started.cast("int")).where("uses > 0").select("doc_id", "source", "lang", "tokens", "uses")


def report(leaves: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """(source, target_share, tokens, capacity, wanted, granted, short[, used, actual_share]) of each
    source; a ``short`` source was granted less than its share: it gives all it may, since whoever
    has more gets at least the share."""
    out = leaves.groupBy("source").agg(F.first("target_share").alias("target_share"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"), F.sum("wanted").alias("wanted"), F.sum("granted").alias("granted"))
    out = out.withColumn("short", F.col("granted") < F.col("wanted") * (1 - ROUNDING))
    if chosen is None:
        return out
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used"))
    everything = used.agg(F.sum("used").alias("_all"))
    out = out.join(F.broadcast(used), "source", "left").join(F.broadcast(everything))
    return out.withColumns({"used": F.coalesce("used", F.lit(0)), "actual_share": F.coalesce(F.col("used") / F.col("_all"), F.lit(0.0))}).drop("_all")
