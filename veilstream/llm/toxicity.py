"""Toxicity by a weighted finite-state grammar over clauses.

Tokens are mapped to symbols: insult, threat, target, negation, reported speech, end of clause, other.  Three
transducers read the symbols of a clause and rewrite them: one marks insults and threats near a target, one
marks those after a negation, one those in reported speech.  Their composition runs once over a clause and puts
out what it has matched, each match with the marks it got; a document is scored by its matched clauses.

The insult lexicon and the weights of the matches are learned from labelled rows: stems (prefixes of words)
that are significantly more frequent in toxic documents, then a logistic model over the counts of matches.
At most ``per_label`` rows of each label are used to fit; scoring reads every document.

Defined results: null counts as empty text, which matches nothing and gets the score of a document without
matches; rows without doc_id are not held out; without labels of both kinds the fixed word lists and weights
apply; a text of any length is scored whole; equal texts and repeated rows get equal scores, a row each; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from math import exp, log, log1p

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import give_back

#: labelled rows of each label that are collected to fit the model
PER_LABEL = 3000
REJECT = 0.7
#: share of toxic texts for which scores are probabilities; at the few per cent of real corpora a single bare insult
#: would stay below the limit
BALANCE = 0.5
#: least log-likelihood ratio of a learned stem
EVIDENCE = 22.0
#: longest stem, in letters
LONGEST = 12
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n\"]")

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
#: marks of a match
AT_TARGET, NEGATED, REPORTED = 1, 2, 4

# Words of the grammar, and insults to start from.
INSULTS = frozenset("idiot idiots moron morons loser losers scum trash stupid pathetic worthless disgusting clown fool imbecile bastard bitch vermin parasite".split())
THREATS = frozenset("kill hurt beat attack stab shoot destroy burn hang strangle punch smash".split())
TARGETS = frozenset("you your you're yourself u he him she her they them their those these tu vous toi du ihr dich dir usted tú vosotros".split())
NEGATIONS = frozenset("not no never none nobody isn't aren't wasn't don't doesn't without ne pas jamais nicht kein keine nie nunca jamás sin".split())
REPORTS = frozenset("said says say wrote writes called calls quoted reported claims claimed dit disait sagte sagt dijo dice".split())
_FIXED = [(TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)]


# ---- transducers ----------------------------------------------------------------------------------

class Transducer:
    """Letter-to-letter: step(state, (symbol, marks)) -> (state, (symbol, marks))."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def __rshift__(self, other: Transducer) -> Transducer:
        """Composition: other reads what self writes.  Arcs are built when first taken."""
        arcs: dict = {}

        def step(state, letter):
            key = state, letter
            if key not in arcs:
                a, out = self.step(state[0], letter)
                b, out = other.step(state[1], out)
                arcs[key] = (a, b), out
            return arcs[key]

        return Transducer((self.start, other.start), step)


def _window(trigger: int, mark: int, reach: int) -> Transducer:
    """Marks insults and threats at most ``reach`` tokens after the trigger; the end of a clause forgets it."""

    def step(left, letter):
        symbol, marks = letter
        if symbol == END:
            return 0, letter
        if symbol == trigger:
            return reach, letter
        if symbol in (INSULT, THREAT) and left:
            letter = symbol, marks | mark
        return max(0, left - 1), letter

    return Transducer(0, step)


GRAMMAR = _window(TARGET, AT_TARGET, 4) >> _window(NEGATION, NEGATED, 3) >> _window(REPORT, REPORTED, 8)


class _Lexicon(dict):
    """Word -> (symbol, stem weight); words not yet seen are looked up by prefix and remembered, up to a bound."""

    def __init__(self, stems: dict[str, float], limit: int = 200_000):
        super().__init__()
        self.stems, self.limit = stems, limit
        self.lengths = sorted({len(s) for s in stems})

    def __missing__(self, word: str):
        found = 0
        if word in ".!?;:\n\"":
            found = END
        else:
            for words, symbol in _FIXED:
                if word in words:
                    found = symbol
            if word in INSULTS or any(word[:n] in self.stems for n in self.lengths if n <= len(word)):
                found = INSULT
        if len(self) >= self.limit:
            self.clear()
        self[word] = found
        return found


def matches(text: str | None, lexicon: _Lexicon) -> list[tuple[int, int]]:
    """(symbol, marks) of each insult or threat of the text, as the grammar puts it out."""
    symbols = list(map(lexicon.__getitem__, _TOKEN.findall((text or "").lower())))
    if INSULT not in symbols and THREAT not in symbols:
        return []
    state, out = GRAMMAR.start, []
    for s in symbols:
        state, letter = GRAMMAR.step(state, (s, 0))
        if letter[0] in (INSULT, THREAT):
            out.append(letter)
    return [x for x in out if x[0] == INSULT or x[1] & AT_TARGET]  # a threat needs someone it is meant for


#: features: a constant, insults by marks, threats by marks, matches for the length of the text
N_FEATURES = 2 + 8 + 4


def features(text: str | None, lexicon: _Lexicon) -> np.ndarray:
    x = np.zeros(N_FEATURES)
    x[0] = 1
    found = matches(text, lexicon)
    for (symbol, marks), n in Counter(found).items():
        x[1 + marks if symbol == INSULT else 9 + (marks >> 1)] = log1p(n)
    x[N_FEATURES - 1] = log1p(100 * len(found) / (1 + len(text or "") / 6))
    return x


# ---- learning -------------------------------------------------------------------------------------

@dataclass
class Model:
    stems: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.array([-4.0, *(6.0, 7.0, 2.0, 3.0, 2.0, 3.0, 1.0, 1.5), *(6.0, 2.0, 2.0, 1.0), 1.0]))

    def scorer(self):
        lexicon = _Lexicon(self.stems)

        def score(text: str | None) -> float:
            z = float(features(text, lexicon) @ self.weights)
            return 1 / (1 + exp(-z)) if z > -30 else 0.0

        return score


def _apart(texts: list[str], size: int = 16) -> list[str]:
    """The texts without copies and near copies of one another: those that share half a bottom sketch of their words."""
    kept, seen = [], {}
    for t in sorted(set(texts)):
        sketch = sorted(xxhash.xxh32_intdigest(w) for w in set(_TOKEN.findall(t.lower())) if len(w) > 3)[:size]
        alike = Counter(n for h in sketch for n in seen.get(h, ()))
        if len(sketch) < size // 2 or not alike or 2 * max(alike.values()) < len(sketch):
            for h in sketch:
                seen.setdefault(h, []).append(len(kept))
            kept.append(t)
    return kept


def _stems(toxic: list[str], clean: list[str], evidence: float) -> dict[str, float]:
    """Prefixes (4 letters and more) whose documents are toxic beyond chance; near copies count once."""
    toxic, clean = _apart(toxic), _apart(clean)

    def counted(texts):
        n: Counter = Counter()
        for t in texts:
            own = set()
            for w in set(_TOKEN.findall(t.lower())):
                own.update(w[:k] for k in range(4, min(len(w), LONGEST) + 1))
            n.update(own)
        return n

    a, b = counted(toxic), counted(clean)
    na, nb = len(toxic), len(clean)

    def ratio(x, y):
        p = (x + y) / (na + nb)
        g = sum(k * log(k / (n * p)) for k, n in ((x, na), (y, nb)) if k)
        g += sum((n - k) * log((n - k) / (n * (1 - p))) for k, n in ((x, na), (y, nb)) if n - k and p < 1)
        return 2 * g

    found: dict[str, float] = {}
    for s in sorted((s for s, k in a.items() if k >= 4), key=lambda s: (len(s), s)):
        x, y = a[s], b.get(s, 0)
        if any(s[:k] in found for k in range(4, len(s))):
            continue
        if x / na > 20 * y / nb and ratio(x, y) >= evidence:
            found[s] = log((x + 0.5) / (na + 1)) - log((y + 0.5) / (nb + 1))
    # the shortest form is only as long as it had to be: lengthen it while (nearly) all its words go on alike
    letters = {}
    for t, k in a.items():
        letters.setdefault(t[:-1], []).append((k, t))
    longer: dict[str, float] = {}
    for s, weight in found.items():
        while s in letters and max(letters[s])[0] >= 0.98 * a[s]:
            s = max(letters[s])[1]
        longer[s] = weight
    return longer


def fit(toxic: list[str], clean: list[str], toxic_share: float = BALANCE, evidence: float = EVIDENCE) -> Model:
    """A model from texts of both labels; toxic_share: of the texts that it is to score."""
    model = Model()
    if not toxic or not clean:
        return model
    model.stems = _stems(toxic, clean, evidence)
    lexicon = _Lexicon(model.stems)
    x = np.array([features(t, lexicon) for t in (*toxic, *clean)])
    y = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    row = np.where(y > 0, share / len(toxic), (1 - share) / len(clean)) * len(y)
    prior = model.weights.copy()
    w, keep = prior.copy(), np.r_[0.02, np.full(N_FEATURES - 1, 0.1)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (row * p * (1 - p))) @ x + np.diag(keep), x.T @ (row * (y - p)) - keep * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = w
    return model


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on at most per_label rows of each label, taken by the hash of doc_id, none of them held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    ids = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        ids = part if ids is None else ids.union(part)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select("toxic", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    by = {k: [] for k in (0, 1)}
    for label, text in sorted(zip(texts["toxic"].to_pylist(), texts["text"].to_pylist(), strict=True)):
        by[label].append(text)
    return fit(by[1], by[0])


def score(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted."""

    def run(batches):
        of = model.scorer()
        for batch in batches:
            x = np.array([of(t) for t in batch["text"].to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(x), pa.array((x >= reject).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        del of
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of docs that score below reject, with all their columns."""

    def run(batches):
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t) < reject for t in batch["text"].to_pylist()], pa.bool_()))
        del of
        give_back()

    return docs.mapInArrow(run, docs.schema)
