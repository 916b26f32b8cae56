"""Toxicity of texts written to hide from word lists.

A noisy channel: the writer meant a plain word and put look-alike characters,
spaces between letters or repeated letters in. Every suspicious token becomes a
lattice of the characters that may have been meant; Viterbi decoding under a
character trigram model, counted over the words of the whole corpus, gives the
likeliest plain form. The restored words are scored by a logistic model.

Training: words and word beginnings whose documents are clearly more often
toxic are chosen by log-likelihood ratio; a logistic regression on their
presence, and on nothing else, is fitted. Both use at most ``TRAIN_ROWS``
labelled rows (the documented bound); the character model covers all rows.

Edge cases: null and empty texts get the score of a text without any feature;
null labels are not learned from; without labelled rows of both kinds every
score is the share of toxic rows seen (0 without any); a document that is
repeated is scored each time; labels repeated for an id count once, the largest.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexigrove.llm.shared import pieces, written

# --- fixed values: look-alike characters ---
MEANT = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il"}

LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE = len(LETTERS)
SYMBOLS = EDGE + 1

THRESHOLD = 0.7
TRAIN_ROWS = 20_000
MOST_FEATURES = 2_000
BEGINNINGS = (4, 5)
KNOWN_WORDS = 300_000

# Costs of the channel, as natural logarithms.
KEEP, REPLACE, DROP_REPEAT, DROP_SPACE = 0.0, -1.0, -0.5, -0.5

_odd = re.compile(r"(?=.*[^\W\d_])(?:.*[0134578@$!+|9]|.*?([^\W\d_])\1\1)", re.S)
_apart = re.compile(r"(?<!\S)(?:[^\W\d_]|[0134578@$!+|9])(?:[ .\-_*][^\W_]|[ .\-_*][@$!+|]){2,}(?![^\s.,;:!?])")
_strip = ".,;:?\"'()[]{}<>*#%&~=/\\-_"


@dataclass
class CharacterModel:
    """Trigram log probabilities with add-one and bigram smoothing."""

    table: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> CharacterModel:
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        two = three.sum(axis=0) + 0.5
        two /= two.sum(axis=1, keepdims=True)
        smooth = three + 2.0 * two[None]
        return CharacterModel(np.log(smooth / smooth.sum(axis=2, keepdims=True)))

    def decode(self, token: str) -> str:
        """The likeliest plain form of a token.

        States are the last two plain characters; of a run of one letter, any
        number of copies beyond the first may be dropped; a space is dropped or
        ends a word.
        """
        table = self.table
        states = {(EDGE, EDGE): (0.0, None)}
        previous = ""
        for char in token:
            if char == " ":
                after = {}
                for (a, b), (score, path) in states.items():
                    for state, total, way in (((a, b), score + DROP_SPACE, path), ((EDGE, EDGE), score + table[a, b, EDGE], (EDGE, path))):
                        if state not in after or total > after[state][0]:
                            after[state] = (total, way)
                states, previous = after, ""
                continue
            if char in LETTERS:
                choices = [(LETTERS.index(char), KEEP)]
            elif char in MEANT:
                choices = [(LETTERS.index(c), REPLACE) for c in MEANT[char]]
            else:
                continue
            after = {}
            for (a, b), (score, path) in states.items():
                for symbol, cost in choices:
                    total = score + cost + table[a, b, symbol]
                    if (b, symbol) not in after or total > after[b, symbol][0]:
                        after[b, symbol] = (total, (symbol, path))
                    if char == previous and b == symbol:
                        total = score + cost + DROP_REPEAT
                        if (a, b) not in after or total > after[a, b][0]:
                            after[a, b] = (total, path)
            states, previous = after, char
        (_, path) = max(((s + table[a, b, EDGE], p) for (a, b), (s, p) in states.items()), key=lambda x: x[0])
        out = []
        while path is not None:
            out.append((LETTERS + " ")[path[0]])
            path = path[1]
        return "".join(reversed(out))


def plain(word: str, model: CharacterModel) -> list[str]:
    """Plain forms of a lower-cased word: itself, and its decoding if it looks obfuscated."""
    bare = word.strip(_strip + "!")
    if _odd.match(word):
        found = model.decode(word.strip(_strip))
        if found and found != bare:
            return [bare, found]
    return [bare]


def restored(text: str, model: CharacterModel) -> Iterator[list[str]]:
    """Plain forms of the distinct words of a text, and of letters set apart."""
    lowered = text.lower()
    for word in set(lowered.split()):
        yield plain(word, model)
    yield from set_apart(lowered, model)


def set_apart(lowered: str, model: CharacterModel) -> Iterator[list[str]]:
    """Forms of letters set apart: all of them joined, and the words that decoding finds."""
    for apart in _apart.finditer(lowered):
        spaced = re.sub(r"[ .\-_*]", " ", apart[0])
        yield [spaced.replace(" ", ""), *model.decode(spaced).split()]


def names_of(form: str) -> list[str]:
    return ["w " + form, *(f"b{n} " + form[:n] for n in BEGINNINGS if len(form) > n)]


def character_counts(docs: DataFrame) -> DataFrame:
    """Letter trigrams of the words of all documents: (code, n), words held apart by edges."""
    code = np.full(256, EDGE, dtype=np.int64)
    for i, letter in enumerate(LETTERS):
        code[ord(letter)] = code[ord(letter.upper())] = i

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in pieces(batches, "text"):
            chars = code[np.frombuffer(b"  " + b"  ".join(t for t in texts if t) + b"  ", dtype=np.uint8)]
            codes = (chars[:-2] * SYMBOLS + chars[1:-1]) * SYMBOLS + chars[2:]
            counts = np.bincount(codes)
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["code", "n"])

    return docs.select("text").mapInArrow(counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame) -> CharacterModel:
    """The model of the corpus; its table has a fixed size (27 cubed)."""
    counts = np.zeros(SYMBOLS ** 3)
    for row in character_counts(docs).collect():
        counts[row["code"]] = row["n"]
    # One space between words gives one edge; a word starts after two.
    cube = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    cube[EDGE, EDGE, :EDGE] += cube[:EDGE, EDGE, :EDGE].sum(axis=0)
    return CharacterModel.of(cube)


@dataclass
class Model:
    """Weights of features and the intercept; ``seen`` is the share of toxic rows."""

    characters: CharacterModel
    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -20.0

    def score(self, text: bytes | None, known: dict) -> float:
        total, used = self.intercept, set()
        for name in self.found(text, known):
            if name not in used:
                used.add(name)
                total += self.weights[name]
        return 1.0 / (1.0 + math.exp(-max(min(total, 500.0), -500.0)))

    def found(self, text: bytes | None, known: dict) -> Iterator[str]:
        """Features of the model that a text has; ``known`` remembers words of this task."""
        if not text:
            return
        lowered = text.decode().lower()
        for word in set(lowered.split()):
            names = known.get(word)
            if names is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                names = tuple(n for form in plain(word, self.characters) for n in names_of(form) if n in self.weights)
                known[word] = names
            yield from names
        for forms in set_apart(lowered, self.characters):
            yield from (n for form in forms for n in names_of(form) if n in self.weights)


def labelled(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, held_out=None) -> DataFrame:
    """At most ``most`` labelled rows, chosen by a hash of the id: doc_id, text, label."""
    marks = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    if held_out is not None:
        marks = marks.filter(~held_out)
    chosen = marks.orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(most)
    # At most ``most`` rows of two numbers are broadcast, so no text is shuffled.
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def train(rows: DataFrame, characters: CharacterModel, most_features: int = MOST_FEATURES) -> Model:
    """Chooses features by log-likelihood ratio and fits their weights."""
    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, labels = [], []
            for text, label in zip(batch["text"], batch["label"]):
                own = {n for forms in restored(text or "", characters) for f in forms for n in names_of(f)}
                names.extend(own)
                labels.extend([label] * len(own))
            counted = pd.DataFrame({"name": names, "label": labels}).groupby("name")["label"].agg(["sum", "size"]).reset_index()
            yield counted.set_axis(["name", "toxic", "n"], axis=1).astype({"toxic": "float64", "n": "int64"})

    totals = rows.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0.0
    if not 0 < toxic < n:
        share = min(max(toxic / n if n else 0.0, 1e-9), 1 - 1e-9)
        return Model(characters, {}, math.log(share / (1 - share)))
    share = toxic / n
    counts = rows.mapInPandas(features, "name string, toxic double, n long").groupBy("name").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), F.col("n") * share) + part(F.col("n") - F.col("toxic"), F.col("n") * (1 - share)))
    telling = (counts.filter((F.col("n") >= 2) & (F.col("toxic") > F.col("n") * share)).withColumn("ratio", ratio)
               .filter("ratio > 12").orderBy(F.desc("ratio"), "name").limit(most_features))
    chosen = sorted(r["name"] for r in telling.select("name").collect())
    index = {name: i for i, name in enumerate(chosen)}
    bare = Model(characters, dict.fromkeys(chosen, 0.0))

    def presence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            yield pd.DataFrame({"label": batch["label"], "has": [
                sorted({index[f] for f in bare.found((t or "").encode(), known)}) for t in batch["text"]]})

    small = rows.mapInPandas(presence, "label double, has array<int>").groupBy("label", "has").count().toPandas()
    weights, intercept = _fit(small, len(chosen))
    return Model(characters, dict(zip(chosen, weights)), intercept)


def _fit(rows: pd.DataFrame, width: int, ridge: float = 0.1, steps: int = 600) -> tuple[list[float], float]:
    """Logistic regression on sparse presence rows, by accelerated gradient descent with weights held at 0 or above."""
    counts, labels = rows["count"].to_numpy(float), rows["label"].to_numpy(float)
    owner = np.repeat(np.arange(len(rows)), [len(h) for h in rows["has"]])
    feature = np.concatenate([np.asarray(h, dtype=np.int64) for h in rows["has"]]) if len(rows) else np.zeros(0, np.int64)
    w, b = np.zeros(width), 0.0
    ahead_w, ahead_b = w.copy(), b
    spread = np.bincount(feature, weights=counts[owner], minlength=width) * 0.25 * (np.bincount(owner, minlength=len(rows)).max(initial=1) + 1) + ridge
    for step in range(steps):
        margin = ahead_b + np.bincount(owner, weights=ahead_w[feature], minlength=len(rows))
        error = counts * (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels)
        new_w = np.maximum(ahead_w - (np.bincount(feature, weights=error[owner], minlength=width) + ridge * ahead_w) / spread, 0.0)
        new_b = ahead_b - error.sum() / (counts.sum() * 0.25 * (np.bincount(owner, minlength=len(rows)).max(initial=1) + 1))
        ahead_w, ahead_b = new_w + step / (step + 3) * (new_w - w), new_b + step / (step + 3) * (new_b - b)
        w, b = new_w, new_b
    return w.tolist(), float(b)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a ``score`` from 0 to 1.

    The model travels with the function, which Spark sends once per executor: a
    broadcast would need this package on the workers.
    """
    columns = [c for c in docs.columns if c != "score"]
    place = columns.index("text")
    schema = docs.select(*columns).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for part, texts in pieces(batches, columns[place]):
            scores = pa.array([model.score(t, known) for t in texts], pa.float64())
            yield pa.RecordBatch.from_arrays([*part.columns, scores], names=[*part.schema.names, "score"])

    return docs.select(*columns).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, held_out=None) -> tuple[DataFrame, Model]:
    """Scores of all documents and the model behind them. ``held_out``: condition on doc_id of rows not to learn from."""
    characters = character_model(docs)
    model = train(written(labelled(docs, labels, held_out=held_out), "labelled"), characters)
    return scored(docs, model), model
