"""Toxicity: a linear classifier on hashed words, regularised by counterfactual swaps of identity terms.

Labelled sentences that name a group are also read with the name swapped for each other name of its kind, and changes of the
score are penalised, so the weight of a group's name can't carry a verdict by itself. So that this holds for names that no
labelled sentence has, each labelled document also lends one sentence, drawn by its hash, which is read with two names of one kind
put into it. A change only depends on the slots that differ, so what reaches the driver is one row per distinct difference.

The L1 term, and whether beginnings and ends of words are features, are chosen by folds of the training rows.

Defined results: a null or empty text is scored by the bias alone; without labels of both kinds the score is the share of
toxic labels (0 where there are none); labels of one document that disagree count as toxic if any does; of rows with one id the
smallest slots are learned from; a text without a sentence lends an empty one.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, workers_ready, written

WORD = regex.compile(r"\w+")
BITS = 18
# At most so many labelled documents train the model: those whose ids hash lowest. This bounds what the driver holds.
TRAINING_ROWS = 8_000
# The L1 term for one document, which falls with the root of their number, is one of SPARSE; chosen on at most CHOOSING_ROWS of them.
SPARSE, FOLDS, CHOOSING_ROWS = (0.017, 0.034, 0.068), 3, 2_000
STEPS, RATE, RIDGE, SWAP = 150, 0.5, 1e-5, 1.0
STORED = 200_000
SENTENCE = regex.compile(r"[^.!?\n。！？]+")

# Names of groups in English, German, French and Spanish; those of a row replace each other in counterfactual sentences.
IDENTITY = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["female", "male"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"], ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "african", "european"], ["gay", "lesbian", "straight", "bisexual", "transgender"],
    ["immigrants", "foreigners", "refugees", "natives"], ["disabled", "deaf", "blind"], ["old", "young", "elderly"],
    ["frauen", "männer"], ["frau", "mann"], ["mädchen", "jungen"], ["muslime", "christen", "juden", "buddhisten", "atheisten"],
    ["muslimische", "christliche", "jüdische"], ["schwarze", "weiße", "asiatische", "afrikanische", "europäische"],
    ["schwule", "lesbische", "bisexuelle", "heterosexuelle"], ["einwanderer", "ausländer", "flüchtlinge", "einheimische"],
    ["behinderte", "gehörlose", "blinde"], ["alte", "junge"],
    ["femmes", "hommes"], ["femme", "homme"], ["filles", "garçons"], ["musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"],
    ["noirs", "blancs", "asiatiques", "africains", "européens"], ["gays", "lesbiennes", "bisexuels", "hétérosexuels"],
    ["immigrés", "étrangers", "réfugiés"], ["handicapés", "sourds", "aveugles"], ["vieux", "jeunes"],
    ["mujeres", "hombres"], ["mujer", "hombre"], ["chicas", "chicos"], ["musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"],
    ["negros", "blancos", "asiáticos", "africanos", "europeos"], ["gais", "lesbianas", "bisexuales", "heterosexuales"],
    ["inmigrantes", "extranjeros", "refugiados"], ["discapacitados", "sordos", "ciegos"], ["viejos", "jóvenes"],
]


class _Slots(dict):
    """Slots of each word: itself and, if asked for, two beginnings and an end, which languages with compounds need; keeps a
    bounded number."""

    def __init__(self, parts: bool = True):
        super().__init__()
        self.parts = parts

    def __missing__(self, word: str) -> list[int]:
        if len(self) > STORED:
            self.clear()
        said = [word]
        if self.parts:
            said += ["^" + word[:n] for n in (5, 7) if len(word) > n] + ([word[-5:] + "$"] if len(word) > 5 else [])
        at = self[word] = [xxhash.xxh64_intdigest(x.encode()) >> (64 - BITS) for x in said]
        return at


def _slots(words: set[str], known: dict[str, list[int]]) -> np.ndarray:
    return np.unique(np.fromiter(itertools.chain.from_iterable(map(known.__getitem__, words)), np.int32))


def slots(text: str, known: dict[str, list[int]]) -> np.ndarray:
    """Distinct slots of a text's words."""
    return _slots(set(WORD.findall(text.lower())), known)


Difference = tuple[tuple[int, ...], tuple[int, ...]]


def _between(words: set[str], others: set[str], known: dict[str, list[int]]) -> Difference:
    own, new = _slots(words, known), _slots(others, known)
    return tuple(np.setdiff1d(own, new).tolist()), tuple(np.setdiff1d(new, own).tolist())


def swapped(text: str, known: dict[str, list[int]], identity: list[list[str]] = IDENTITY) -> Counter[Difference]:
    """Slots (lost, gained) by swaps of names in each sentence of a text: one swap for each row named and each shift along it."""
    rows: dict[str, list[tuple[int, int]]] = {}
    for at, row in enumerate(identity):
        for i, term in enumerate(row):
            rows.setdefault(term, []).append((at, i))
    out: Counter[Difference] = Counter()
    for said in SENTENCE.findall(text.lower()):
        found = set(WORD.findall(said))
        named: dict[int, list[int]] = {}
        for word in found & rows.keys():
            for at, i in rows[word]:
                named.setdefault(at, []).append(i)
        for at, places in named.items():
            row = identity[at]
            for shift in range(1, len(row)):
                other = {row[i]: row[(i + shift) % len(row)] for i in places}
                out[_between(found, {other.get(w, w) for w in found}, known)] += 1
    out.pop(((), ()), None)  # every name of the row swapped among themselves
    return out


def planted(text: str, known: dict[str, list[int]], identity: list[list[str]] = IDENTITY) -> Difference | None:
    """Slots that differ between one sentence of the text with a name and with another of its kind, all drawn by the text's hash."""
    if not identity:
        return None
    draw = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    said = SENTENCE.findall(text.lower()) or [""]
    words = set(WORD.findall(said[draw % len(said)]))
    row = identity[(draw >> 20) % len(identity)]
    first = (draw >> 40) % len(row)
    second = (first + 1 + (draw >> 50) % max(len(row) - 1, 1)) % len(row)
    return _between(words | {row[first]}, words | {row[second]}, known)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    parts: bool = True
    swaps: int = 0  # counterfactual sentences that took part, those with planted names included

    def score(self, at: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[at].sum() + self.bias, -30, 30))))


def learn(rows: list[np.ndarray], toxic: np.ndarray, swaps: dict[Difference, int], swap: float = SWAP, sparse: float = SPARSE[1]) -> Model:
    """Proximal gradient steps on the logistic loss, an L1 and L2 term and the mean squared change of the score by swaps."""
    size = 1 << BITS
    if len(rows) == 0 or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(rows) else 0.0
        return Model(np.zeros(size), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    owner = np.repeat(np.arange(len(rows), dtype=np.int64), [len(r) for r in rows])
    at = np.concatenate(rows).astype(np.int64)
    used, at = np.unique(at, return_inverse=True)  # slots that no row has only meet the penalties and stay at zero
    # Both kinds weigh the same.
    weight = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    many = len(used)
    place = np.full(size, -1)
    place[used] = np.arange(many)
    share = np.fromiter(swaps.values(), np.float64, len(swaps))
    share = share / max(share.sum(), 1.0)
    pair_at = np.array([x for lost, gained in swaps for x in (*lost, *gained)], np.int64)
    pair_owner = np.repeat(np.arange(len(swaps)), [len(lost) + len(gained) for lost, gained in swaps])
    sign = np.array([x for lost, gained in swaps for x in (*[1.0] * len(lost), *[-1.0] * len(gained))])
    seen = place[pair_at] >= 0
    pair_at, pair_owner, sign = place[pair_at[seen]], pair_owner[seen], sign[seen]
    sparse = sparse / np.sqrt(len(rows))
    w, bias, square, bias_square = np.zeros(many), 0.0, np.full(many, 1e-8), 1e-8
    for _ in range(STEPS):
        z = np.bincount(owner, w[at], len(rows)) + bias
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic)
        slope = np.bincount(at, g[owner], many) + RIDGE * w
        if len(pair_at):
            change = np.bincount(pair_owner, sign * w[pair_at], len(swaps)) * share
            slope += 2 * swap * np.bincount(pair_at, change[pair_owner] * sign, many)
        square += slope**2
        bias_square += g.sum() ** 2
        pace = RATE / np.sqrt(square)
        w = w - pace * slope
        w = np.sign(w) * np.maximum(np.abs(w) - pace * sparse, 0)
        bias -= RATE / np.sqrt(bias_square) * g.sum()
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, float(bias), swaps=sum(swaps.values()))


def chosen_by_folds(kinds: dict[bool, list[np.ndarray]], toxic: np.ndarray, swaps: dict[bool, dict[Difference, int]]) -> tuple[bool, float]:
    """(word parts, L1 term) of the least loss on rows left out, both labels weighing the same; ties go to the first of the list."""
    n = min(len(toxic), CHOOSING_ROWS)
    fold, best = np.arange(n) % FOLDS, (np.inf, True, SPARSE[1])
    if n < 10 * FOLDS or toxic[:n].min() == toxic[:n].max():
        return best[1:]
    weight = np.where(toxic[:n] > 0, 0.5 / toxic[:n].sum(), 0.5 / (n - toxic[:n].sum()))
    for parts, sparse in itertools.product(kinds, SPARSE):
        loss = 0.0
        for out in range(FOLDS):
            model = learn([kinds[parts][i] for i in np.flatnonzero(fold != out)], toxic[:n][fold != out], swaps[parts], sparse=sparse)
            for i in np.flatnonzero(fold == out):
                loss -= weight[i] * np.log(np.clip(abs(1 - toxic[i] - model.score(kinds[parts][i])), 1e-9, 1))
        best = min(best, (loss, parts, sparse), key=lambda x: x[0])
    return best[1:]


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, identity: list[list[str]] = IDENTITY, swap: float = SWAP) -> Model:
    """Learn from labels (doc_id, toxic); the ``rows`` documents whose ids hash lowest take part. They are ordered by that hash, so
    the rows that choose the terms are a sample of them."""
    workers_ready(docs.sparkSession)
    chosen = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("toxic").alias("_toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    pairs = "array<struct<lost:array<int>,gained:array<int>,k:bigint>>"
    pair = pa.list_(pa.struct([("lost", pa.list_(pa.int32())), ("gained", pa.list_(pa.int32())), ("k", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, plain = _Slots(True), _Slots(False)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1)]
            for known in (whole, plain):
                columns.append(pa.array([slots(t, known) for t in texts], pa.list_(pa.int32())))
                changes = [swapped(t, known, identity) for t in texts]
                for t, c in zip(texts, changes):
                    if (put := planted(t, known, identity)) is not None:
                        c[put] += 1
                columns.append(pa.array([[{"lost": lost, "gained": gained, "k": k} for (lost, gained), k in sorted(c.items())] for c in changes], pair))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "toxic", "own_true", "swaps_true", "own_false", "swaps_false"])

    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(
        F.col("_id").cast("long"), F.col("_toxic").cast("int"), "text")
    made = taken.mapInArrow(run, f"id long, toxic int, own_true array<int>, swaps_true {pairs}, own_false array<int>, swaps_false {pairs}")
    # One row per chosen document, also where a document's row repeats. Read more than once, hence written.
    one = written(made.groupBy("id").agg(F.min(F.struct("toxic", "own_true", "own_false", "swaps_true", "swaps_false")).alias("r")).select("id", "r.*"), "toxicity")
    got = one.select("id", "toxic", "own_true", "own_false", F.xxhash64("id").alias("h")).toArrow().sort_by([("h", "ascending"), ("id", "ascending")])
    toxic = got["toxic"].to_numpy().astype(float)
    kinds, swaps = {}, {}
    for parts in (True, False):
        kinds[parts] = [np.asarray(x) for x in got[f"own_{parts}".lower()].to_numpy()]
        told = one.select(F.explode(f"swaps_{parts}".lower()).alias("s")).groupBy("s.lost", "s.gained").agg(F.sum("s.k").alias("k")).toArrow().to_pylist()
        swaps[parts] = {(tuple(r["lost"]), tuple(r["gained"])): r["k"] for r in sorted(told, key=lambda r: (r["lost"], r["gained"]))}
    parts, sparse = chosen_by_folds(kinds, toxic, swaps)
    model = learn(kinds[parts], toxic, swaps[parts], swap, sparse)
    model.parts = parts
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights
    workers_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        known = _Slots(own.parts)
        for batch in slices(batches):
            scores = [own.score(slots(t or "", known)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
