"""The subject areas of notebooks, by clustering and leaf mixtures.

1. Every notebook is reduced to the words of its text and code cells; words are counted per language,
   and words that most notebooks of a language use are left out as boilerplate.
2. Notebooks become normalised vectors (inverse document frequency, random projection) and are
   clustered by bisecting k-means: each leaf is cut along its principal direction and refined by
   Lloyd steps.  All notebooks take part in every step; only sums of leaves reach the driver.
3. A leaf is named after the subject whose hand labels and description terms it attracts beyond
   chance; its discriminative terms thereby speak for that subject.  A subject that wins no leaf gets
   its labelled notebooks for one.
4. Every cell is a mixture of the named leaves, by what its terms say of each; the parts of the leaves
   of one subject add up.  Rounds of reassigning all cells to leaves sharpen the terms of each leaf,
   as a leaf of whole notebooks still holds cells about other things; a notebook gets the subjects
   that lead the mixtures of its cells.

A notebook has a subject when at least two of its text cells are about it, or, where no text cell is
about any other subject, when most of its code cells take their names from it.

Defined results: null and empty texts have no subject; unknown, blank or ``none`` labels name no leaf;
labels that contradict each other count in proportion; without labels the descriptions alone name the
leaves; an empty corpus gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rootline.functions.labels import label
from rootline.llm.notebooks import batch_cells, compact_columns
from rootline.session import materialize

WORD = re.compile(r"[^\W\d_]{3,}")

#: Labelled notebooks that may be used to name leaves; which ones is decided by a hash of the id.
MAX_LABELLED = 50_000

#: A term is boilerplate of a language beyond this share of its notebooks, and noise where it reaches
#: that share, and that many, of the notebooks of no language.
BOILERPLATE, RARE, RARE_DOCS = 0.3, 0.001, 3

#: Terms that a vocabulary may have, since sums by leaf and term come to the driver; a larger one is
#: refused.
MAX_TERMS = 300_000

DIMENSIONS, LEAVES, LEVELS = 128, 48, 6

#: Labelled notebooks (by share of raters) that stand for a subject which won no leaf.
SEEDED = 2.0

#: Sums of one key that one task folds.
FOLD_TASKS = 64

#: Rounds of reassigning cells, and the weight of a notebook's code in all but the last.
ROUNDS, CONTEXT = 4, 2.0

STAGE = "doc_id long, lang string, kinds string, ends array<int>, words array<string>"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each text and code cell, and after the notebooks the number of
    notebooks that each word occurs in, by language, as rows without id."""
    counts: dict[str, Counter] = {}
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("kinds", pa.string()), ("ends", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])

    def counted() -> pa.RecordBatch:
        rows = [(None, lang, None, list(c.values()), list(c)) for lang, c in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        langs = batch.column(5).to_pylist()
        out: list[list] = [[], [], [], [], []]
        for (doc_id, cells), lang in zip(batch_cells(batch), langs, strict=True):
            kinds, ends, words = [], [], []
            for kind, content in cells:
                if kind != "output":
                    kinds.append(kind[0])
                    words += dict.fromkeys(WORD.findall(content.lower()))
                    ends.append(len(words))
            counts.setdefault(lang, Counter()).update(set(words))
            counts[lang][""] += 1
            for held, item in zip(out, (doc_id, lang, "".join(kinds), ends, words), strict=True):
                held.append(item)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)
        if sum(map(len, counts.values())) > 300_000:
            yield counted()
    if counts:
        yield counted()


def split(documents: DataFrame) -> DataFrame:
    """The words of all notebooks, stored; see ``_split``."""
    lang = F.coalesce(F.substring(label(F.col("lang")), 1, 2), F.lit(""))
    named = documents.withColumn("_lang", lang)
    return materialize(compact_columns(named, "_lang").mapInArrow(_split, STAGE), "words")


@dataclass
class Vocabulary:
    """The terms that can tell subjects apart, with their weights."""

    terms: list[str]
    idf: np.ndarray
    docs: int
    #: the terms that are boilerplate in notebooks of a language; under "" those of all other languages
    barred: dict[str, np.ndarray] = field(default_factory=dict)

    @property
    def number(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.terms)}


def vocabulary(words: DataFrame) -> Vocabulary:
    """Terms between noise and boilerplate, at most ``MAX_TERMS``.  The noise floor holds by language,
    so that a language of few notebooks among many others has terms as well."""
    counts = words.where("doc_id is null").select("lang", F.explode(F.arrays_zip("words", "ends")).alias("x")).groupBy("lang", F.col("x.words").alias("term")).agg(F.sum("x.ends").alias("docs"))
    counts = materialize(counts, "counts")
    docs = counts.where("term = ''").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    # languages of at least that share, so there are at most 500
    sizes = {r.lang: r.docs for r in counts.where((F.col("term") == "") & (F.col("lang") != "") & (F.col("docs") >= max(20, 0.002 * docs))).collect()}
    spoken = F.col("lang").isin(list(sizes))
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("lang")] if sizes else F.lit(1)
    group = F.when(spoken, F.col("lang")).otherwise("")
    every = F.sum("docs").over(Window.partitionBy("term"))
    each = counts.where("term <> ''").withColumn("all_docs", every).select("term", "docs", "all_docs", group.alias("group"), F.when(spoken, size).alias("size"))
    frequent = F.when(F.col("group") != "", F.col("docs") / F.col("size") > BOILERPLATE).otherwise(F.col("all_docs") > BOILERPLATE * docs + 1)
    common = F.coalesce(F.col("docs") >= F.greatest(F.lit(float(RARE_DOCS)), RARE * F.col("size")), F.lit(False))
    each = each.withColumns({"barred": frequent, "common": common})
    kept = each.groupBy("term").agg(F.max("all_docs").alias("docs"), F.max("common").alias("common"), F.bool_and("barred").alias("everywhere"), F.collect_set(F.when(F.col("barred"), F.col("group"))).alias("barred"))
    kept = kept.where((F.col("common") | (F.col("docs") >= max(RARE_DOCS, RARE * docs))) & ~F.col("everywhere"))
    rows = sorted((r.term, r.docs, r.barred) for r in kept.select("term", "docs", "barred").limit(MAX_TERMS + 1).collect())
    if len(rows) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms")
    barred: dict[str, list[int]] = {}
    for i, (_, _, groups) in enumerate(rows):
        for lang in groups:
            barred.setdefault(lang, []).append(i)
    barred = {lang: np.array(barred.get(lang, []), dtype=np.int32) for lang in [*sizes, ""]}
    return Vocabulary([t for t, *_ in rows], np.log((docs + 1) / (np.array([n for _, n, _ in rows], dtype=float) + 1)), docs, barred)


VECTORS = "doc_id long, kinds string, ends array<int>, terms array<int>, vector binary"


def vectors(words: DataFrame, vocab: Vocabulary, dimensions: int = DIMENSIONS, seed: int = 7) -> DataFrame:
    """(doc_id, kinds, ends, terms, vector): the terms of each cell and the normalised vector of each
    notebook, stored; a notebook without terms has the zero vector."""
    number = words.sparkSession.sparkContext.broadcast(vocab.number)
    weights = words.sparkSession.sparkContext.broadcast(vocab.idf.astype(np.float32))
    barred = words.sparkSession.sparkContext.broadcast(vocab.barred)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, idf = number.value.get, weights.value
        directions = np.random.default_rng(seed).standard_normal((len(idf), dimensions), dtype=np.float32)
        for batch in batches:
            flat = batch.column(3).flatten()
            coded = flat.dictionary_encode()
            lookup = np.fromiter((get(w, -1) for w in coded.dictionary.to_pylist()), dtype=np.int32, count=len(coded.dictionary))
            codes = lookup[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.empty(0, np.int32)
            starts = np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy(zero_copy_only=False))])
            ends, langs = batch.column(2).to_pylist(), batch.column(4).to_pylist()
            out_ends, out_terms, out_vectors = [], [], []
            for i in range(batch.num_rows):
                own = codes[starts[i] : starts[i + 1]]
                out_of = barred.value.get(langs[i], barred.value.get("", ()))
                kept = (own >= 0) & ~np.isin(own, out_of) if len(out_of) else own >= 0
                out_ends.append(np.concatenate([[0], np.cumsum(kept)])[ends[i]].astype(np.int32) if ends[i] else np.empty(0, np.int32))
                own = own[kept]
                out_terms.append(own)
                distinct = np.unique(own)
                v = idf[distinct] @ directions[distinct] if len(distinct) else np.zeros(dimensions, np.float32)
                size = np.linalg.norm(v)
                out_vectors.append((v / size if size else v).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out_ends, pa.list_(pa.int32())), pa.array(out_terms, pa.list_(pa.int32())), pa.array(out_vectors, pa.binary())], names=["doc_id", "kinds", "ends", "terms", "vector"])

    return materialize(words.where("doc_id is not null").select("doc_id", "kinds", "ends", "words", "lang").mapInArrow(run, VECTORS), "vectors")


class Tree:
    """A tree of cuts: ``cuts[node]`` holds the two children of an inner node and their centroids."""

    def __init__(self) -> None:
        self.cuts: dict[int, tuple[int, int, np.ndarray]] = {}
        self.leaves = [0]

    def cut(self, leaf: int, centroids: np.ndarray) -> None:
        """Replace a leaf by two."""
        a = max([0, *(x for c in self.cuts.values() for x in c[:2])]) + 1
        self.cuts[leaf] = (a, a + 1, centroids)
        self.leaves = sorted([*(x for x in self.leaves if x != leaf), a, a + 1])

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), dtype=np.int32)
        for node in sorted(self.cuts):
            if len(own := np.flatnonzero(at == node)):
                a, b, centroids = self.cuts[node]
                near = points[own] @ centroids.T
                at[own] = np.where(near[:, 1] > near[:, 0], b, a)
        return at


def _points(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), -1)


def _gather(table: DataFrame, columns: list[str], work) -> dict[int, np.ndarray]:
    """Sum arrays by key over all rows: ``work`` adds a batch to {key: array}; partial sums are
    folded by key on the executors, and the totals (one per key) come to the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            work(batch, sums)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype(np.float64).tobytes() for v in sums.values()], pa.binary())], names=["key", "total"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, total in zip(batch["key"], batch["total"], strict=True):
                held = np.frombuffer(total)
                sums[key] = sums[key] + held if key in sums else held
        if sums:
            yield pd.DataFrame({"key": list(sums), "total": [v.tobytes() for v in sums.values()]})

    out = table.select(*columns).mapInArrow(partial, "key int, total binary")
    if table._jdf.rdd().getNumPartitions() > FOLD_TASKS:  # many tasks of one key meet in pieces first
        out = out.withColumn("piece", F.pmod(F.spark_partition_id(), F.lit(FOLD_TASKS))).repartition("key", "piece").drop("piece").mapInPandas(fold, "key int, total binary")
    out = out.repartition("key").mapInPandas(fold, "key int, total binary")
    return {r.key: np.frombuffer(r.total) for r in out.collect()}


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=-1, keepdims=True)
    return (v / np.where(size > 0, size, 1)).astype(np.float32)


def bisect(points: DataFrame, dimensions: int = DIMENSIONS, leaves: int = LEAVES, levels: int = LEVELS, least: float = 0.004) -> Tree:
    """Bisecting k-means over all vectors: per level, every leaf that is large enough is cut along
    its principal direction, and the cuts take two Lloyd steps.

    A pass sums, for each leaf or each side of a cut, the number of points, the points, and (for the
    next cut) their products.
    """
    tree = Tree()

    def passing(moments: bool) -> dict[int, np.ndarray]:
        def work(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
            own = _points(batch.column(0))
            own = own[np.abs(own).sum(axis=1) > 0]
            at = tree.assign(own)
            for leaf in np.unique(at):
                part = own[at == leaf].astype(np.float64)
                found = np.concatenate([[len(part)], part.sum(axis=0), *((part.T @ part).ravel(),) * moments])
                sums[int(leaf)] = sums[int(leaf)] + found if leaf in sums else found

        return _gather(points, ["vector"], work)

    sums = passing(True)
    total = sum(v[0] for v in sums.values())
    for _ in range(levels):
        able = sorted((leaf for leaf in sums if sums[leaf][0] >= max(8, least * total)), key=lambda x: -sums[x][0])[: leaves - len(tree.leaves)]
        if not able:
            break
        for leaf in sorted(able):
            n, mean = sums[leaf][0], sums[leaf][1 : 1 + dimensions] / sums[leaf][0]
            spread = sums[leaf][1 + dimensions :].reshape(dimensions, dimensions) / n - np.outer(mean, mean)
            values, axes = np.linalg.eigh(spread)
            step = axes[:, -1] * np.sqrt(max(values[-1], 0))
            step *= np.sign(step[np.argmax(np.abs(step))])
            tree.cut(leaf, _unit(np.stack([mean - step, mean + step])))
        for last in (False, True):
            sums = passing(last)
            for leaf in able:
                a, b, centroids = tree.cuts[leaf]
                tree.cuts[leaf] = (a, b, _unit(np.stack([sums[x][1 : 1 + dimensions] if x in sums else c for x, c in zip((a, b), centroids, strict=True)])))
    return tree


def read_labels(labels: DataFrame | None, subjects: list[str]) -> dict[int, dict[str, float]]:
    """{doc_id: {subject: share of its raters}} of at most ``MAX_LABELLED`` labelled notebooks."""
    if labels is None:
        return {}
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label(F.col("subject")).alias("subject")).where("doc_id is not null and subject is not null")
    per_doc = known.where(F.col("subject").isin([*subjects, "none"])).groupBy("doc_id").agg(F.collect_list("subject").alias("subjects"))
    out = {}
    for r in per_doc.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED).collect():
        counts = Counter(r.subjects)
        out[r.doc_id] = {s: n / len(r.subjects) for s, n in counts.items()}
    return out


def profile(points: DataFrame, tree: Tree, vocab: Vocabulary, labelled: dict[int, dict[str, float]], subjects: list[str]) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Per leaf the number of notebooks with each term, and the votes for each subject and for none."""
    shared = points.sparkSession.sparkContext.broadcast(labelled)
    size, place = len(vocab.terms), {s: i for i, s in enumerate([*subjects, "none"])}

    def work(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        own = _points(batch.column(2))
        at = np.where(np.abs(own).sum(axis=1) > 0, tree.assign(own), -1)
        lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(own)), lengths)
        pairs = np.unique(row.astype(np.int64) * max(size, 1) + flat) if len(flat) else np.empty(0, np.int64)
        row, term = pairs // max(size, 1), pairs % max(size, 1)
        votes = shared.value
        for leaf in np.unique(at):
            found = np.zeros(1 + size + len(place))
            found[0] = (at == leaf).sum()
            found[1 : 1 + size] = np.bincount(term[at[row] == leaf], minlength=size)
            if (key := int(leaf)) in sums:
                found += sums[key]
            sums[key] = found
        for doc_id, leaf in zip(batch.column(0).to_pylist(), at.tolist(), strict=True):
            for subject, share in votes.get(doc_id, {}).items():
                sums[leaf][1 + size + place[subject]] += share

    found = _gather(points, ["doc_id", "terms", "vector"], work)
    return {k: v[: 1 + size] for k, v in found.items()}, {k: v[1 + size :] for k, v in found.items()}


def seeded(points: DataFrame, vocab: Vocabulary, labelled: dict[int, dict[str, float]], missing: list[str]) -> dict[str, np.ndarray]:
    """For subjects that won no leaf the labelled notebooks of each, as a leaf of its own: their number
    and how many have each term, by the share of raters."""
    shared = points.sparkSession.sparkContext.broadcast({d: {missing.index(s): x for s, x in v.items() if s in missing} for d, v in labelled.items() if any(s in missing for s in v)})
    size = len(vocab.terms)

    def work(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            for subject, share in shared.value.get(doc_id, {}).items():
                found = sums.setdefault(subject, np.zeros(1 + size))
                found[0] += share
                found[1 + np.unique(batch.column(1)[i].values.to_numpy(zero_copy_only=False))] += share

    return {missing[k]: v for k, v in _gather(points, ["doc_id", "terms"], work).items() if v[0] >= SEEDED}


def discriminative(leaves: dict[int, np.ndarray], leaf: int) -> np.ndarray:
    """How much likelier each term is in a leaf than elsewhere, as a smoothed log ratio."""
    total = sum(leaves.values())
    inside, outside = leaves[leaf], total - leaves[leaf]
    return np.log((inside[1:] + 0.5) / (inside[0] + 1.0)) - np.log((outside[1:] + 0.5) / (outside[0] + 1.0))


def name_leaves(leaves: dict[int, np.ndarray], votes: dict[int, np.ndarray], vocab: Vocabulary, descriptions: dict[str, str]) -> dict[int, str]:
    """{leaf: subject} for leaves that votes or description terms speak for beyond chance."""
    subjects = list(descriptions)
    told = [np.array([any(t.startswith(w[: max(4, len(w) - 2)]) for w in words) for t in vocab.terms]) for words in ([w for w in WORD.findall((descriptions[s] + " " + s).lower()) if len(w) > 3] for s in subjects)]
    base = sum(votes.values()) + 1.0
    names = {}
    for leaf in leaves:
        if leaf < 0:
            continue
        lift = discriminative(leaves, leaf)
        share = votes[leaf] / base
        share = share / max(share.sum(), 1e-9)
        hinted = np.array([np.clip(lift[t], 0, None).sum() if t.any() else 0.0 for t in told])
        hinted = hinted / max(hinted.sum(), 1e-9)
        score = share[:-1] * min(1.0, votes[leaf].sum() / 3) + 0.3 * hinted
        best = int(np.argmax(score))
        if score[best] > 1.5 * score.sum() / max(2, len(subjects)) and score[best] > share[-1]:
            names[leaf] = subjects[best]
    return names


def _by_subject(owner: np.ndarray, n: int) -> np.ndarray:
    """A matrix that adds up the leaves of each subject."""
    return (owner[:, None] == np.arange(n)).astype(np.float32)


def speaking(leaves: dict[int, np.ndarray], names: dict[int, str], subjects: list[str], seeds: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What each term says of each named leaf at first, and the subject number of each such leaf.

    A term speaks for the subject whose leaves hold it more often than all others do, split among
    those leaves by how often each holds it.  ``seeds`` are leaves of subjects that won none.
    """
    total = sum(leaves.values())
    extra = {-2 - i: s for i, s in enumerate(seeds or {})}
    leaves, names = leaves | {i: seeds[s] for i, s in extra.items()}, names | extra
    named = sorted(names)
    owner = np.array([subjects.index(names[x]) for x in named], dtype=int)
    out = np.zeros((len(total) - 1, len(subjects)))
    for i in sorted(set(owner.tolist())):
        own = sum(leaves[x] for x, o in zip(named, owner, strict=True) if o == i)
        rate_in, rate_out = (own[1:] + 0.1) / (own[0] + 1.0), (total[1:] - own[1:] + 0.1) / (total[0] - own[0] + 1.0)
        out[:, i] = rate_in / (rate_in + rate_out)
    # a term speaks for the subject that claims most of it
    odds = np.where(out > 0.5, out / (1.0001 - out), 0.0) ** 2
    says = odds / np.maximum(odds.sum(axis=1, keepdims=True), 1e-9) * (out.max(axis=1, keepdims=True, initial=0) > 0.6)
    counts = np.stack([leaves[x][1:] / (leaves[x][0] + 1.0) for x in named], axis=1) if named else np.zeros((len(total) - 1, 0))
    return _split_among_leaves(says, counts, owner), owner


def _split_among_leaves(says: np.ndarray, counts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """What terms say of subjects, split among the leaves of each by counts, evenly without any."""
    sums = counts @ _by_subject(owner, says.shape[1])
    alone = np.bincount(owner, minlength=says.shape[1])
    share = np.where(sums[:, owner] > 0, counts / np.maximum(sums[:, owner], 1e-12), 1.0 / np.maximum(alone[owner], 1))
    return says[:, owner] * share


def cell_mixtures(terms: np.ndarray, ends: np.ndarray, says: np.ndarray) -> np.ndarray:
    """For each cell (given by the ends of its terms) the mass of each leaf."""
    mass = np.zeros((len(ends), says.shape[1]), dtype=np.float64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    held = np.flatnonzero(ends > starts)
    if len(held):
        mass[held] = np.add.reduceat(says[terms], starts[held], axis=0, dtype=np.float64)
    return mass


def decide(mass: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The subject of each cell, -1 for none: the one with most of the mass, from two terms on in
    text and one in code."""
    best = mass.argmax(axis=1) if mass.shape[1] else np.zeros(len(mass), dtype=int)
    top = mass[np.arange(len(mass)), best] if len(mass) else np.empty(0)
    clear = (top >= np.where(text, 1.2, 0.6)) & (top >= 0.6 * np.maximum(mass.sum(axis=1), 1e-9))
    return np.where(clear, best, -1)


def _cells(batch: pa.RecordBatch, kinds: int, ends: int, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All cells of a batch in one row: ends of their terms, terms, whether text, row number."""
    lengths = batch.column(terms).value_lengths().to_numpy(zero_copy_only=False)
    base = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    per_row = batch.column(ends).value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), per_row)
    all_ends = batch.column(ends).flatten().to_numpy(zero_copy_only=False) + base[row] if len(row) else np.empty(0, dtype=np.int64)
    text = np.frombuffer("".join(batch.column(kinds).to_pylist()).encode(), dtype=np.uint8) == ord("t")
    return all_ends, batch.column(terms).flatten().to_numpy(zero_copy_only=False), text, row


def sharpen(points: DataFrame, says: np.ndarray, owner: np.ndarray, n: int, context: float) -> np.ndarray:
    """One round of reassigning cells to leaves: what each term says of the leaves (whose subjects,
    ``n`` in all, ``owner`` tells), by the cells it occurs in.

    ``context`` is the weight that the names in a notebook's code have for its text cells.  They are
    written alike whatever the language of the text, so they carry subjects over to languages whose
    leaves are mixed.
    """
    shared = points.sparkSession.sparkContext.broadcast(says.astype(np.float32))
    size, m = says.shape

    def work(batch: pa.RecordBatch, sums: dict[int, np.ndarray]) -> None:
        ends, terms, text, row = _cells(batch, 0, 1, 2)
        if not len(terms) or not m:
            return
        mass = cell_mixtures(terms, ends, shared.value)
        if context:
            around = np.zeros((batch.num_rows, m))
            np.add.at(around, row[~text], mass[~text])
            mass[text] += context * around[row[text]]
        about = decide(mass @ _by_subject(owner, n), text)
        # the leaf of that subject that has most of the cell
        leaf = np.where(owner == about[:, None], mass, -1.0).argmax(axis=1)
        to = np.where(about < 0, m, leaf)
        own = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
        found = np.bincount(terms.astype(np.int64) * (m + 1) + to[own], minlength=size * (m + 1)).astype(float)
        sums[0] = sums[0] + found if 0 in sums else found

    found = _gather(points, ["kinds", "ends", "terms"], work)
    if 0 not in found:
        return says
    by_leaf = found[0].reshape(size, m + 1)
    counts = by_leaf[:, :m] @ _by_subject(owner, n)
    rate = counts / (counts.sum(axis=0) + 1.0)
    share = rate / np.maximum(rate.sum(axis=1, keepdims=True), 1e-12)
    settled = counts.sum(axis=1, keepdims=True) / np.maximum(by_leaf.sum(axis=1, keepdims=True), 1.0)
    said = np.where((share > 0.15) & (settled > 0.1), share**2 / np.maximum((share**2).sum(axis=1, keepdims=True), 1e-12), 0.0) * (share.max(axis=1, keepdims=True, initial=0) > 0.45)
    return _split_among_leaves(said, by_leaf[:, :m], owner)


@dataclass
class Model:
    """What clustering found: the subjects, the terms, what each says of the named leaves, and the
    subject number of each of those."""

    subjects: list[str]
    vocabulary: Vocabulary
    tree: Tree
    names: dict[int, str]
    says: np.ndarray
    owner: np.ndarray


def fit(points: DataFrame, vocab: Vocabulary, descriptions: dict[str, str], labels: DataFrame | None, rounds: int = ROUNDS) -> Model:
    """Cluster, name the leaves and sharpen the terms."""
    subjects = list(descriptions)
    tree = bisect(points)
    labelled = read_labels(labels, subjects)
    leaves, votes = profile(points, tree, vocab, labelled, subjects)
    names = name_leaves(leaves, votes, vocab, descriptions)
    missing = [s for s in subjects if s not in names.values()]
    says, owner = speaking(leaves, names, subjects, seeded(points, vocab, labelled, missing) if missing and labelled else None)
    for r in range(rounds):
        says = sharpen(points, says, owner, len(subjects), CONTEXT if r < rounds - 1 else 0.0)
    if silent := [s for i, s in enumerate(subjects) if not says[:, owner == i].any()]:
        warnings.warn(f"no terms speak for {len(silent)} of {len(subjects)} subjects, so no notebook gets them: {', '.join(silent[:20])}", stacklevel=3)
    return Model(subjects, vocab, tree, names, says, owner)


def assign(points: DataFrame, model: Model) -> DataFrame:
    """(doc_id, subject, text_cells, code_cells): the subjects of each notebook, by the leaf mixtures
    of its cells."""
    shared = points.sparkSession.sparkContext.broadcast(model.says.astype(np.float32))
    subjects, owner = model.subjects, model.owner

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, terms, text, row = _cells(batch, 1, 2, 3)
            n = len(subjects)
            about = decide(cell_mixtures(terms, ends, shared.value) @ _by_subject(owner, n), text)
            of_text = np.zeros((batch.num_rows, n), dtype=np.int32)
            of_code = np.zeros((batch.num_rows, n), dtype=np.int32)
            for table, own in ((of_text, text), (of_code, ~text)):
                hit = own & (about >= 0)
                np.add.at(table, (row[hit], about[hit]), 1)
            code = np.bincount(row[~text], minlength=batch.num_rows)
            quiet = of_text.sum(axis=1, keepdims=True) - of_text == 0  # no text cell about anything else
            chosen = (of_text >= 2) | (quiet & (2 * of_code > code[:, None]))
            docs, which = np.nonzero(chosen)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), pa.array([subjects[w] for w in which], pa.string()), pa.array(of_text[docs, which], pa.int32()), pa.array(of_code[docs, which], pa.int32())], names=["doc_id", "subject", "text_cells", "code_cells"])

    return points.select("doc_id", "kinds", "ends", "terms").mapInArrow(run, "doc_id long, subject string, text_cells int, code_cells int")


def read_subjects(subjects: DataFrame, most: int = 1000) -> dict[str, str]:
    """{subject: description}; at most ``most`` subjects, as they become columns of matrices."""
    rows = subjects.select(label(F.col("subject")).alias("subject"), F.coalesce(F.col("description"), F.lit("")).alias("description")).where("subject is not null and subject <> 'none'").groupBy("subject").agg(F.min("description").alias("description")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} subjects")
    return {r.subject: r.description for r in sorted(rows)}


def classify(documents: DataFrame, subjects: DataFrame, labels: DataFrame | None = None) -> tuple[DataFrame, Model | None]:
    """(doc_id, subject, text_cells, code_cells) of all notebooks, and the model."""
    descriptions = read_subjects(subjects)
    words = split(documents)
    vocab = vocabulary(words)
    if not vocab.terms or not descriptions:
        return documents.sparkSession.createDataFrame([], "doc_id long, subject string, text_cells int, code_cells int"), None
    points = vectors(words, vocab)
    model = fit(points, vocab, descriptions, labels)
    return assign(points, model), model
