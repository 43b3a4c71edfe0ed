"""Toxicity as a sparse linear classifier with counterfactual regularisation.

Features are words and beginnings of words that occur at least once, twice or
three times in a text. Sentences of the labelled documents that name a group
are copied with the name swapped for another; the squared change of the score
between a sentence and its copy is a penalty of the fit, so that naming a group
cannot carry weight of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablequill.llm import labelled
from tablequill.llm import textkernel as tk
from tablequill.llm.rows import boxed, unboxed
from tablequill.session import settle

# Labelled documents the model is fitted on, at most about so many.
TRAINING_ROWS = 20_000
# Features with a weight: those that tell the classes apart best.
VOCABULARY = 4096
# A feature must occur in so many sampled documents of the rarer class.
MIN_DOCUMENTS = 3
# Beginnings of words, in bytes, and the counts that make a feature.
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = 3
# Sentences that name a group and are swapped, of all sampled documents together, at most
# about so many; beyond that a sample by their hashes, spread over all of them.
SWAPPED_SENTENCES = 200_000

# Names of groups, by language and kind; a name is swapped for the next of its kind, and for
# the neutral word of its language, so that names cannot gain weight together either.
IDENTITY_TERMS = {
    "people": {
        "gender": ["women", "men", "woman", "man", "girls", "boys", "transgender", "nonbinary"],
        "belief": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic",
                   "christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"],
        "orientation": ["gay", "lesbian", "straight", "bisexual", "queer", "heterosexual"],
        "origin": ["black", "white", "asian", "african", "european", "latino", "hispanic", "arab",
                   "indian", "chinese", "mexican", "american", "indigenous"],
        "status": ["immigrants", "refugees", "migrants", "citizens", "foreigners", "natives"],
        "body": ["blind", "deaf", "disabled", "autistic", "elderly", "old", "young"],
    },
    "leute": {
        "gender": ["frauen", "männer", "frau", "mann", "mädchen", "jungen"],
        "belief": ["christen", "muslime", "juden", "hindus", "buddhisten", "atheisten", "katholiken"],
        "orientation": ["schwule", "lesben", "heterosexuelle", "bisexuelle"],
        "origin": ["schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber", "türken", "deutsche"],
        "status": ["einwanderer", "flüchtlinge", "ausländer", "einheimische"],
        "body": ["blinde", "gehörlose", "behinderte", "autisten", "alte", "junge"],
    },
    "gente": {
        "gender": ["mujeres", "hombres", "mujer", "hombre", "niñas", "niños"],
        "belief": ["cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos", "católicos"],
        "orientation": ["gays", "lesbianas", "heterosexuales", "bisexuales"],
        "origin": ["negros", "blancos", "asiáticos", "africanos", "europeos", "árabes", "latinos", "gitanos"],
        "status": ["inmigrantes", "refugiados", "extranjeros", "ciudadanos"],
        "body": ["ciegos", "sordos", "discapacitados", "autistas", "ancianos", "jóvenes"],
    },
    "gens": {
        "gender": ["femmes", "hommes", "femme", "homme", "filles", "garçons"],
        "belief": ["chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées", "catholiques"],
        "orientation": ["homosexuels", "lesbiennes", "hétérosexuels", "bisexuels"],
        "origin": ["noirs", "blancs", "asiatiques", "africains", "européens", "arabes", "roms"],
        "status": ["immigrés", "réfugiés", "étrangers", "citoyens"],
        "body": ["aveugles", "sourds", "handicapés", "autistes", "vieux", "jeunes"],
    },
}


def _swaps() -> dict[str, tuple[str, str]]:
    """Each name with the next of its kind and the neutral word of its language."""
    return {
        t: (names[(i + 1) % len(names)], neutral)
        for neutral, kinds in IDENTITY_TERMS.items() for names in kinds.values() for i, t in enumerate(names)
    }


def _named_pattern() -> re.Pattern:
    return re.compile(r"\b(" + "|".join(sorted(_swaps(), key=len, reverse=True)) + r")\b")


def naming_sentences(text: str, pattern: re.Pattern) -> list[str]:
    """The sentences of a lower-case text that name a group."""
    return [s for s in re.split(r"[.!?\n]+", text) if pattern.search(s)]


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, text number) of every word, and of its beginnings, in lower-case texts."""
    found = tk.words(data, offsets, terms=True)
    own = tk.owners(found.bounds)
    lengths = found.ends - found.starts
    keys, owned = [tk.word_hashes(data, found)], [own]
    values = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at, grown = np.arange(len(own)), np.zeros(len(own), np.uint64)
    for size in range(max(PREFIXES)):
        longer = lengths[at] > size
        at, grown = at[longer], grown[longer]
        grown = tk.mix(grown + values[data[found.starts[at] + size]])
        if size + 1 in PREFIXES:
            keys.append(grown)
            owned.append(own[at])
    return np.concatenate(keys), np.concatenate(owned)


def _runs(keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text number, level) once per text and key; level 0, 1, 2 for one, two, more."""
    order = np.lexsort((own, keys))
    keys, own = keys[order], own[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.concatenate([at, [len(keys)]]))
    return keys[at], own[at], np.minimum(counts, LEVELS) - 1


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts.fill_null("") if texts.null_count else texts)


@dataclass
class Model:
    """``weights[level, i]`` counts if ``keys[i]`` occurs more than ``level`` times in the text."""

    base: float
    keys: np.ndarray
    weights: np.ndarray

    def margins(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.base)
        steps = np.cumsum(self.weights, axis=0)
        for first, data, offsets in tk.slices(_lower(texts)):
            at, own, level = _runs(*_known(*_features(data, offsets), self.keys))
            n = len(offsets) - 1
            if len(at):
                out[first : first + n] += np.bincount(own, steps[level, at], n)
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(texts), -30, 30)))


def _known(keys: np.ndarray, own: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the vocabulary, text number) of the keys that are in it."""
    if len(vocabulary) == 0 or len(keys) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    low = np.zeros(1 << 20, bool)
    low[(vocabulary & np.uint64(0xFFFFF)).astype(np.int64)] = True
    maybe = low[(keys & np.uint64(0xFFFFF)).astype(np.int64)]
    keys, own = keys[maybe], own[maybe]
    at = np.minimum(np.searchsorted(vocabulary, keys), len(vocabulary) - 1)
    hit = vocabulary[at] == keys
    return at[hit], own[hit]


def _counter(vocabulary: np.ndarray | None):
    """Function from sampled documents to (key, level, documents, documents of target 1).

    Only keys of the vocabulary are counted, if there is one; a batch of
    documents gives one row per key and level.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            target = batch.column("_target").to_numpy(zero_copy_only=False)
            keys, levels, ones = [], [], []
            for first, data, offsets in tk.slices(_lower(batch.column("_text"))):
                key, own = _features(data, offsets)
                if vocabulary is not None:
                    at, own = _known(key, own, vocabulary)
                    key = vocabulary[at]
                key, own, level = _runs(key, own)
                keys.append(key)
                levels.append(level)
                ones.append(target[first + own] > 0)
            if not keys:
                continue
            key, top, one = np.concatenate(keys), np.concatenate(levels), np.concatenate(ones)
            for level in range(LEVELS):
                some = top >= level
                distinct, at = np.unique(key[some], return_inverse=True)
                n = len(distinct)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(distinct.view(np.int64)), pa.array(np.full(n, level, np.int32)),
                     pa.array(np.bincount(at, minlength=n)),
                     pa.array(np.bincount(at, one[some], n).astype(np.int64))],
                    ["feature", "level", "n", "n_one"],
                )

    return count


def _counts(texts: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    return (
        texts.select("_text", "_target")
        .mapInArrow(_counter(vocabulary), "feature long, level int, n long, n_one long")
        .groupBy("feature", "level")
        .agg(F.sum("n").alias("n"), F.sum("n_one").alias("n_one"))
    )


def _count_naming(texts: pa.Array) -> pa.Array:
    names = _named_pattern()
    return pa.array([len(naming_sentences(t, names)) for t in _lower(texts).to_pylist()], pa.int64())


def _examples(vocabulary: np.ndarray, share: float):
    """Function from sampled documents to rows of feature numbers, level * size + place.

    Of the sentences that name a group the ``share`` with the lowest hashes is swapped.

    ``kind`` -1 is the document itself; 0, 1, ... a swapped sentence, of which
    ``idx`` has what the swap adds and ``gone`` what it removes.
    """
    swaps, size, names = _swaps(), max(len(vocabulary), 1), _named_pattern()

    def numbers(texts: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, data, offsets in tk.slices(texts):
            at, own, level = _runs(*_known(*_features(data, offsets), vocabulary))
            own, at = (np.concatenate([x[level >= k] + (k * size if which else 0)
                                       for k in range(LEVELS)])
                       for which, x in enumerate((own, at)))
            order = np.argsort(own, kind="stable")
            out += np.split(at[order], np.searchsorted(own[order], np.arange(1, len(offsets) - 1)))
        return out

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _lower(batch.column("_text"))
            ids = batch.column("_label_id").to_pylist()
            target = batch.column("_target").to_pylist()
            out = [(ids[i], target[i], -1, x.tolist(), []) for i, x in enumerate(numbers(texts))]
            for i, text in enumerate(texts.to_pylist()):
                named = naming_sentences(text, names)
                if share < 1:
                    named = [s for s in named if zlib.crc32(s.encode()) < share * (1 << 32)]
                swapped = [names.sub(lambda m: swaps[m.group(1)][k], s) for k in (0, 1) for s in named]
                both = numbers(pa.array(named * 2 + swapped, pa.string()))
                for k, (a, b) in enumerate(zip(both[: len(swapped)], both[len(swapped) :])):
                    add, gone = np.setdiff1d(b, a), np.setdiff1d(a, b)
                    out.append((ids[i], target[i], k, add.tolist(), gone.tolist()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [batch.schema.field("_label_id").type, pa.int32(), pa.int32(),
                     pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(columns, kinds)],
                ["_label_id", "_target", "kind", "idx", "gone"],
            )

    return rows


def _sparse(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return rows, np.concatenate(lists).astype(np.int64) if lists else np.empty(0, np.int64)


def fit(
    documents: list[np.ndarray], y: np.ndarray, added: list[np.ndarray], removed: list[np.ndarray],
    n_features: int, sparsity: float = 3e-4, swap_penalty: float = 10.0, rounds: int = 400,
) -> tuple[float, np.ndarray]:
    """(base, weights) by accelerated proximal gradient steps.

    Minimises the mean log loss + ``sparsity`` |w| + ``swap_penalty`` times the
    mean squared change of the margin over the swapped sentences.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    base, w = float(np.log(share / (1 - share))), np.zeros(n_features)
    if len(y) == 0 or y.min() == y.max() or n_features == 0:
        return base, w
    row, col = _sparse(documents)
    add_row, add_col = _sparse(added)
    gone_row, gone_col = _sparse(removed)
    n, m = len(y), max(len(added), 1)

    def change(v: np.ndarray) -> np.ndarray:
        return (np.bincount(add_row, v[add_col], len(added))
                - np.bincount(gone_row, v[gone_col], len(added)))

    def slope(v: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], n) + b, -30, 30)))
        grad = np.bincount(col, (p - y)[row] / n, n_features)
        if len(added):
            d = change(v) * (2 * swap_penalty / m)
            grad += np.bincount(add_col, d[add_row], n_features)
            grad -= np.bincount(gone_col, d[gone_row], n_features)
        return grad, float((p - y).mean())

    # largest curvature, by power iteration on the quadratic bound
    v, bound = np.ones(n_features), 1.0
    for _ in range(20):
        v = v / max(np.linalg.norm(v), 1e-12)
        u = np.bincount(col, np.bincount(row, v[col], n)[row] / (4 * n), n_features)
        if len(added):
            d = change(v) * (2 * swap_penalty / m)
            u = u + np.bincount(add_col, d[add_row], n_features) - np.bincount(gone_col, d[gone_row], n_features)
        bound, v = np.linalg.norm(u), u
    rate = 1 / (1.2 * bound + 0.25)
    ahead, ahead_base, speed = w.copy(), base, 1.0
    for _ in range(rounds):
        grad, grad_base = slope(ahead, ahead_base)
        new = ahead - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - rate * sparsity, 0)
        new_base = ahead_base - rate * grad_base
        faster = (1 + np.sqrt(1 + 4 * speed**2)) / 2
        pull = (speed - 1) / faster
        ahead, ahead_base = new + pull * (new - w), new_base + pull * (new_base - base)
        w, base, speed = new, new_base, faster
    return float(base), w


def _vocabulary(texts: DataFrame, total: int, ones: int) -> np.ndarray:
    """Keys of the VOCABULARY features with the largest chi-square statistic.

    Keys that are rare in the rarer class are left out first; how many remain is
    bounded by the sample.
    """
    rarer = 1 if 2 * ones <= total else 0
    known = _counts(texts.where(F.col("_target") == rarer)).where(
        (F.col("level") == 0) & (F.col("n") >= MIN_DOCUMENTS)
    )
    keys = np.unique(known.select("feature").toPandas()["feature"].to_numpy(np.int64).view(np.uint64))
    share = ones / total
    excess = F.col("n_one") - F.col("n") * share
    chi = excess * excess / (F.col("n") * (share * (1 - share)))
    best = _counts(texts, keys).orderBy(chi.desc(), "feature", "level").limit(VOCABULARY)
    return np.unique(best.select("feature").toPandas()["feature"].to_numpy(np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAINING_ROWS,
          id_col: str = "doc_id", text: str = "text") -> Model:
    """Fit on about ``rows`` labelled documents (see ``labelled.training_labels``).

    The ids of the sample are broadcast (bounded by ``rows``) and one text of
    each is stored, the one with the lowest hash where an id repeats; features
    are counted in Spark. Names of groups are always among the features, so that
    the penalty sees them. All sentences that name a group are swapped, up to
    SWAPPED_SENTENCES of all documents.
    """
    sample = F.broadcast(labelled.training_labels(labels, label, rows))
    found = docs.select(F.col(id_col).alias("_label_id"), F.col(text).alias("_text")).join(sample, "_label_id")
    texts = settle(
        found.groupBy("_label_id", "_target").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text")), "labelled"
    )
    naming = F.arrow_udf(_count_naming, T.LongType())("_text")
    total, ones, sentences = texts.select("_target", naming.alias("n")).agg(
        F.count("*"), F.coalesce(F.sum("_target"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    share = min(1.0, SWAPPED_SENTENCES / max(sentences, 1))
    [(_, data, offsets)] = tk.slices(pa.array(sorted(_swaps())))
    names = np.unique(_features(data, offsets)[0])
    chosen = _vocabulary(texts, total, ones) if 0 < ones < total else names[:0]
    vocabulary = np.unique(np.concatenate([chosen, names]))
    schema = T.StructType([
        texts.schema["_label_id"], T.StructField("_target", T.IntegerType()),
        T.StructField("kind", T.IntegerType()), T.StructField("idx", T.ArrayType(T.IntegerType())),
        T.StructField("gone", T.ArrayType(T.IntegerType())),
    ])
    found = texts.mapInArrow(_examples(vocabulary, share), schema).toPandas()
    # the order of rows decides the last bits of sums: make it the same on every run
    found = found.sort_values(["_label_id", "kind", "_target"], kind="stable")
    whole, swapped = found[found["kind"] < 0], found[found["kind"] >= 0]
    base, weights = fit(
        [np.asarray(x) for x in whole["idx"]], whole["_target"].to_numpy(np.float64),
        [np.asarray(x) for x in swapped["idx"]], [np.asarray(x) for x in swapped["gone"]],
        LEVELS * len(vocabulary),
    )
    weights = weights.reshape(LEVELS, -1)
    used = (weights != 0).any(axis=0)
    return Model(base, vocabulary[used], weights[:, used])


def score(model: Model, text: str = "text") -> Column:
    """Probability that a text is toxic; empty and NULL texts get the base rate."""

    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts))

    return F.arrow_udf(scored, T.DoubleType())(F.col(text))


def filter_documents(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a score below ``limit``, all their columns unchanged."""
    model = train(docs, labels)
    scored = boxed(docs, score(model).alias("toxicity"))
    return unboxed(scored.where(F.col("toxicity") < limit))


def op2_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    return docs.select(
        "doc_id", labelled.held_out("doc_id").alias("held_out"), score(model).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
