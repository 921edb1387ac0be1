"""Toxicity by a counterfactually regularised classifier.

A sparse logistic model over the words that a text has.  Labelled sentences
are rewritten with one identity term swapped for another, or left out; terms
are listed ones and words that the sample uses as those.  The training loss
adds the squared change of the score between both versions, so a neutral
mention of a group moves no score, and texts with and without it are judged
alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, doc_text, held_out
from .quality import sample_labelled

#: Bounds of what is learned from: documents of a class, each with its whole text, and features.
SAMPLE_DOCS, VOCABULARY = 2000, 50000
#: Plain sentences that get a term, beside all that have one, the weight of the score changes, and of the weights' absolute values.
SWAPS, CHANGE, SPARSE = 4000, 1.0, 2e-4
#: Places between the same two words that another word must share with known terms to be taken for one.
PLACES = 3
#: Rounds of training at most, and the change of the greatest weight, as a share of it, that ends them.
STEPS, STILL = 400, 1e-4
THRESHOLD = 0.5
#: Words that name groups, in English, French, German and Spanish; each list swaps within itself.
IDENTITIES = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "african", "european", "latino", "arab", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("american", "mexican", "chinese", "indian", "german", "french", "spanish", "russian", "turkish"),
    ("immigrant", "refugee", "citizen", "foreigner", "migrant"),
    ("immigrants", "refugees", "citizens", "foreigners", "migrants"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "athées", "catholiques"),
    ("noirs", "blancs", "arabes", "africains", "asiatiques"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("homosexuels", "hétérosexuels", "lesbiennes"),
    ("handicapés", "sourds", "aveugles"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "atheisten", "katholiken"),
    ("schwarze", "weiße", "araber", "afrikaner", "asiaten"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("schwule", "lesben", "heterosexuelle"),
    ("behinderte", "gehörlose", "blinde"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "ateos", "católicos"),
    ("negros", "blancos", "árabes", "africanos", "asiáticos"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("homosexuales", "heterosexuales", "lesbianas"),
    ("discapacitados", "sordos", "ciegos"),
)
_WORD = re.compile(r"[^\W\d_]+")


#: Lengths of the word beginnings that are features too: endings vary, the stem tells.
STEMS = (4, 5, 6, 7)
#: Words whose features a task remembers.
REMEMBERED = 1 << 18


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case: symbols stuck to a word don't hide it."""
    return _WORD.findall(text.lower())


def features_of(words: set[str]) -> set[str]:
    """The words, and the beginnings of those that are longer."""
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


@dataclass(frozen=True)
class ToxicityModel:
    """Words with a weight, and the bias; bounded by VOCABULARY."""

    weights: dict[str, float]
    bias: float

    def scorer(self):
        """A function from words to the logit; each feature counts once, in a fixed order."""
        found: dict[str, frozenset[str]] = {}
        known = self.weights.keys()

        def logit(words: list[str]) -> float:
            have: set[str] = set()
            for w in set(words):
                own = found.get(w)
                if own is None:
                    if len(found) >= REMEMBERED:
                        found.clear()
                    own = found[w] = frozenset(features_of({w}) & known)
                if own:
                    have |= own
            return self.bias + sum(self.weights[x] for x in sorted(have))

        return logit


def found_terms(sentences: list[tuple[int, list[str]]], known: Iterable[str]) -> list[str]:
    """Words that are used as known terms are: in at least PLACES places between the same two words.

    sentences have the label of their text.  A word that toxic texts have
    oftener than any known term is no group's name but what is said about it.
    """
    known = set(known)
    places = {(words[k - 1], words[k + 1]) for _, words in sentences if not known.isdisjoint(words) for k in range(1, len(words) - 1) if words[k] in known}
    if not places:
        return []
    seen: dict[str, list[int]] = {}
    for y, words in sentences:
        for w in set(words):
            n = seen.setdefault(w, [0, 0])
            n[y] += 1
    share = lambda w: seen[w][1] / sum(seen[w])
    most = max((share(w) for w in known if w in seen), default=0.0)
    used: dict[str, set[tuple[str, str]]] = {}
    for _, words in sentences:
        for before, w, after in zip(words, words[1:], words[2:], strict=False):
            if w not in known and (before, after) in places:
                used.setdefault(w, set()).add((before, after))
    return sorted(w for w, at in used.items() if len(at) >= PLACES and share(w) <= most)


def swapped(sentences: list[list[str]], limit: int = SWAPS, groups: tuple[tuple[str, ...], ...] = IDENTITIES) -> list[tuple[set[str], set[str]]]:
    """Pairs of versions of labelled sentences that differ in an identity term.

    A sentence with a term gets the next of its list, and its neutral form
    without it; every such sentence does.  Of the others, the limit's number of
    least hash get a term by their place, so every term is seen beside ordinary
    words.
    """
    group_of = {w: k for k, words in enumerate(groups) for w in words}
    flat = [w for words in groups for w in words]
    out: list[tuple[set[str], set[str]]] = []
    plain = [k for k, words in enumerate(sentences) if words and group_of.keys().isdisjoint(words)]
    plain = set(sorted(plain, key=lambda k: (zlib.crc32(" ".join(sentences[k]).encode()), k))[:limit])
    for k, words in enumerate(sentences):
        for w in dict.fromkeys(x for x in words if x in group_of):
            group = groups[group_of[w]]
            if len(group) > 1:
                other = group[(group.index(w) + 1 + k % (len(group) - 1)) % len(group)]
                out.append((set(words), {other if x == w else x for x in words}))
            out.append((set(words), {x for x in words if x != w}))
        if k in plain:
            a = flat[k % len(flat)]
            group = groups[group_of[a]]
            b = group[(group.index(a) + 1) % len(group)]
            out += [({*words, a}, {*words, b}), ({*words, a}, set(words))]
    return out


def _rows(sets: list[set[str]], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    cols = [sorted(ids[w] for w in s if w in ids) for s in sets]
    return np.repeat(np.arange(len(sets)), [len(c) for c in cols]), np.array([x for c in cols for x in c], dtype=np.int64)


def fit_from_sample(sample: list[tuple[int, int, str]], counts: dict[int, int], change: float = CHANGE) -> ToxicityModel:
    """Accelerated proximal gradient on log loss + change * mean squared score change + SPARSE * sum of |weights|."""
    docs = [(y, [words_of(s) for s in re.split(r"[.!?\n]+", text)]) for _, y, text in sample]
    sets = [features_of({w for s in sentences for w in s}) for _, sentences in docs]
    y = np.array([d[0] for d in docs], dtype=float)
    total = sum(counts.values()) or 1
    prior = float(np.log((counts.get(1, 0) + 0.5) / (counts.get(0, 0) + 0.5))) if counts else 0.0
    if not len(y) or y.min() == y.max():
        return ToxicityModel({}, prior)
    more = tuple(found_terms([(d, s) for d, sentences in docs for s in sentences], (w for words in IDENTITIES for w in words)))
    groups = (*IDENTITIES, more) if more else IDENTITIES
    n_in: dict[str, list[int]] = {}
    for label, s in zip(y, sets, strict=True):
        for w in s:
            n_in.setdefault(w, [0, 0])[int(label)] += 1
    size = [max(1, int((y == k).sum())) for k in (0, 1)]
    least = 2 if len(y) > 50 else 1
    lean = lambda w: abs(n_in[w][1] / size[1] - n_in[w][0] / size[0])
    usual = sorted((w for w, c in n_in.items() if sum(c) >= least), key=lambda w: (-lean(w), w))[:VOCABULARY]
    terms = features_of({w for words in groups for w in words}) - set(usual)
    ids = {w: i for i, w in enumerate([*usual, *sorted(terms)])}
    row, col = _rows(sets, ids)
    full = np.unique(row)
    firsts = np.searchsorted(row, full)
    pairs = [(features_of(a), features_of(b)) for a, b in swapped([s for _, sentences in docs for s in sentences if len(s) > 2], groups=groups)]
    # Only what one version has and the other hasn't changes the score.
    row_a, col_a = _rows([a - b for a, b in pairs], ids)
    row_b, col_b = _rows([b - a for a, b in pairs], ids)
    row_c, col_c, sign = np.concatenate([row_a, row_b]), np.concatenate([col_a, col_b]), np.repeat([1.0, -1.0], [len(row_a), len(row_b)])
    weight = np.where(y == 1, counts.get(1, size[1]) / size[1], counts.get(0, size[0]) / size[0]) / total
    n, m, d = len(y), max(1, len(pairs)), len(ids)

    def sums(x: np.ndarray) -> np.ndarray:
        """The weights of each document's features, added up."""
        out = np.zeros(n)
        if len(full):
            out[full] = np.add.reduceat(x[col], firsts)
        return out

    def penalty(x: np.ndarray) -> np.ndarray:
        """The gradient of the mean squared score change."""
        moved = np.bincount(row_c, weights=sign * x[col_c], minlength=m) * (2 * change / m)
        return np.bincount(col_c, weights=sign * moved[row_c], minlength=d)

    def curved(x: np.ndarray, shift: float) -> tuple[np.ndarray, float]:
        """The loss's greatest curvature, applied to a direction."""
        pull = 0.25 * weight * (sums(x) + shift)
        return np.bincount(col, weights=pull[row], minlength=d) + penalty(x), float(pull.sum())

    # The step is the inverse of the greatest curvature, found by power iteration from a fixed start.
    x, shift, curvature = np.ones(d), 1.0, 1.0
    for _ in range(30):
        x, shift = curved(x, shift)
        curvature = float(np.sqrt((x * x).sum() + shift * shift)) or 1.0
        x, shift = x / curvature, shift / curvature
    step = 1.0 / (1.1 * curvature)
    w, b, v, vb, t = np.zeros(d), prior, np.zeros(d), prior, 1.0
    for _ in range(STEPS):
        z = sums(v) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        new = v - step * (np.bincount(col, weights=g[row], minlength=d) + penalty(v))
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * SPARSE)
        new_b = vb - step * float(g.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / nt * (new - w), new_b + (t - 1) / nt * (new_b - b)
        still = np.abs(new - w).max(initial=0.0) <= STILL * np.abs(new).max(initial=0.0) and np.any(new)
        w, b, t = new, new_b, nt
        if still:
            break
    names = list(ids)
    return ToxicityModel({names[i]: float(w[i]) for i in np.flatnonzero(np.abs(w) > 1e-6)}, float(b))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learns from labels.toxic of rows that aren't held out, at most per_class of each."""
    sample, counts = sample_labelled(docs, labels, "toxic", per_class)
    return fit_from_sample(sample, counts)


def score(docs: DataFrame, model: ToxicityModel, out: str = "toxicity_score") -> DataFrame:
    """docs with a score from 0 to 1, higher for toxic text, from all words of the whole text.

    A null or empty text has no words and gets the score of the bias alone.
    """

    def kernel():
        logit = model.scorer()

        def work(part: pa.RecordBatch) -> list[pa.Array]:
            z = np.array([logit(words_of(t or "")) for t in part.column(part.schema.get_field_index("text")).to_pylist()])
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

        return work

    return append_columns(docs.withColumn("text", F.col("text").cast("string")), kernel, [T.StructField(out, T.DoubleType(), False)])


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's rows: doc_id, held_out, score and predicted."""
    scored = score(doc_text(docs), fit(docs, labels), "score")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
