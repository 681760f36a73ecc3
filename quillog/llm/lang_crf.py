"""Language identification by a linear-chain conditional random field over words.

Every word has features: prefixes, suffixes, character n-grams (all hashed) and membership in the
lexicon of each language. Learned transitions connect neighbouring words, so that a text may switch
languages. Forward-backward gives each word's label distribution; a document takes the label with
the most mass over all of its words, and that share is its score.

The model is fitted on a bounded sample: at most about ``docs_per_lang`` passages of ``passage``
characters for each language, drawn by hash. Training sequences are spliced from passages of one to
three languages, which is where transitions between languages are learned from.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count, islice

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .names import free_prefix

#: A letter and the letters and combining marks after it; numbers of any kind aren't letters.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNKNOWN = "und"
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A scramble of 64-bit integers."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


@dataclass
class Model:
    labels: list[str]
    emit: np.ndarray  # hashed features (the last rows: lexicons, bias) x labels
    move: np.ndarray  # labels x labels
    begin: np.ndarray
    lexicons: list[set[str]]
    bits: int
    key: str = field(default="")

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features of all words, word after word, and how many each has: runs of two and three
        characters of the marked word, its prefixes and suffixes of up to three, lexicons and a bias."""
        points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(U)
        size = np.array([len(w) + 2 for w in words], dtype=np.int64)
        start = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        left = np.repeat(start + size, size) - np.arange(len(points))  # characters from here to the end
        run = mix(points + U(1))
        owner, code = [], []
        for k in (2, 3, 4):
            inside = np.flatnonzero(left >= k)
            longer = np.zeros_like(run)
            longer[inside] = mix(run[inside] * U(0x9E3779B97F4A7C15) + points[inside + k - 1])
            run = longer
            if k < 4:
                owner.append(word[inside])
                code.append(run[inside])
            some = np.flatnonzero(size > k)
            owner += [some, some]
            code += [mix(run[start[some]] + U(k)), mix(run[start[some] + size[some] - k] + U(16 + k))]
        mask, top = U((1 << self.bits) - 1), 1 << self.bits
        known = [(i, top + k) for i, w in enumerate(words) for k, lexicon in enumerate(self.lexicons) if w in lexicon]
        flat = [(c & mask).astype(np.int64) for c in code]
        owner += [np.array([i for i, _ in known], dtype=np.int64), np.arange(len(words))]
        flat += [np.array([k for _, k in known], dtype=np.int64), np.full(len(words), top + len(self.lexicons))]
        owners = np.concatenate(owner)
        return np.concatenate(flat)[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))

    def scores(self, words: list[str]) -> np.ndarray:
        flat, sizes = self.features(words)
        return np.add.reduceat(self.emit[flat], np.cumsum(sizes) - sizes)


def forward_backward(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label distributions (docs x time x labels) and expected moves, summed over all.

    ``scores`` is padded at the end; positions at or after a document's length have no mass.
    """
    docs, time, labels = scores.shape
    step = np.exp(move - move.max())
    local = np.exp(scores - scores.max(2, keepdims=True))
    alpha = np.empty_like(local)
    now = local[:, 0] * np.exp(begin - begin.max())
    alpha[:, 0] = now / now.sum(1, keepdims=True)
    for t in range(1, time):
        now = (alpha[:, t - 1] @ step) * local[:, t]
        alpha[:, t] = now / now.sum(1, keepdims=True)
    inside = np.arange(time)[None, :] < lengths[:, None]
    gamma = np.zeros_like(local)
    moves = np.zeros((labels, labels))
    beta = np.ones((docs, labels), dtype=local.dtype)
    for t in range(time - 1, -1, -1):
        if t + 1 < time:
            ahead = local[:, t + 1] * beta
            on = inside[:, t + 1]
            both = alpha[:, t, :, None] * step[None] * ahead[:, None, :]
            total = both.sum((1, 2), keepdims=True)
            moves += (both / total)[on].sum(0)
            beta = np.where(on[:, None], ahead @ step.T, 1.0)
            beta /= beta.sum(1, keepdims=True)
        now = alpha[:, t] * beta
        gamma[:, t] = now / now.sum(1, keepdims=True)
    gamma[~inside] = 0
    return gamma, moves


def label_mass(scores: np.ndarray, lengths: np.ndarray, move: np.ndarray, begin: np.ndarray, run: int = 64) -> np.ndarray:
    """Sum over words of the label distributions, documents x labels.

    ``scores`` holds the words of all documents, one after another; each document has a word at least.
    Documents are cut into runs of ``run`` words. The product of a run's steps carries a document's
    distribution over it, so all runs are walked side by side and only the steps from run to run of
    one document, forward and back, go one by one: the result is that of one walk over each document.
    """
    labels = scores.shape[1]
    pieces = -(-lengths // run)
    n, first = int(pieces.sum()), np.cumsum(pieces) - pieces
    place = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(first, lengths) + place // run
    on = np.zeros((run, n), dtype=bool)
    on[place % run, row] = True
    local = np.ones((run, n, labels))
    local[place % run, row] = np.exp(scores - scores.max(1, keepdims=True))
    step = np.exp(move - move.max())
    enter = np.broadcast_to(step, (n, labels, labels)).copy()  # into the first word of each run
    enter[first] = np.exp(begin - begin.max())[None, None, :]

    def unit(x: np.ndarray) -> np.ndarray:
        return x / x.sum(-1, keepdims=True)

    product = enter * local[0][:, None, :]
    for t in range(1, run):
        live = np.flatnonzero(on[t])
        product[live] = (product[live].reshape(-1, labels) @ step).reshape(-1, labels, labels) * local[t][live][:, None, :]
        if t % 16 == 0:
            product /= product.sum((1, 2), keepdims=True)
    product /= product.sum((1, 2), keepdims=True)

    before, after = np.full((n, labels), 1 / labels), np.ones((n, labels))
    longest_first = np.argsort(-pieces, kind="stable")
    has = np.searchsorted(-pieces[longest_first], -np.arange(1, pieces.max() + 1), side="right")
    for k in range(1, int(pieces.max())):
        own = first[longest_first[: has[k]]] + k
        before[own] = unit(np.einsum("di,dij->dj", before[own - 1], product[own - 1]))
    for k in range(int(pieces.max()) - 1, 0, -1):
        own = first[longest_first[: has[k]]] + k
        after[own - 1] = unit(np.einsum("dij,dj->di", product[own], after[own]))

    alpha = np.empty_like(local)
    alpha[0] = unit(np.einsum("di,dij->dj", before, enter) * local[0])
    for t in range(1, run):
        alpha[t] = np.where(on[t][:, None], unit((alpha[t - 1] @ step) * local[t]), alpha[t - 1])
    mass, beta = np.zeros((n, labels)), after
    for t in range(run - 1, -1, -1):
        mass += unit(alpha[t] * beta) * on[t][:, None]
        beta = np.where(on[t][:, None], unit((local[t] * beta) @ step.T), beta)
    return np.add.reduceat(mass, first)


def fit(passages: dict[str, list[str]], *, bits: int, lexicon_words: int, sequences: int, epochs: int, seed: int) -> Model:
    """Fit by minibatch gradient steps with per-weight rates (Adagrad) on spliced sequences."""
    labels = sorted(passages)
    words = {lang: [w for w in (WORD.findall(p.lower()) for p in passages[lang]) if w] for lang in labels}
    lexicons = [{w for w, _ in Counter(x for p in words[lang] for x in p).most_common(lexicon_words)} for lang in labels]
    n = len(labels)
    model = Model(labels, np.zeros(((1 << bits) + n + 1, n)), np.zeros((n, n)), np.zeros(n), lexicons, bits)
    usable = [i for i, lang in enumerate(labels) if words[lang]]
    if not usable:
        return model
    draw = np.random.default_rng(seed)
    spliced = []
    for _ in range(sequences):
        own, tags = [], []
        for i in draw.choice(usable, size=int(draw.integers(1, 4))):
            source = words[labels[i]][int(draw.integers(len(words[labels[i]])))]
            size = int(draw.integers(3, 25))
            at = int(draw.integers(max(1, len(source) - size + 1)))
            own += source[at : at + size]
            tags += [i] * len(source[at : at + size])
        spliced.append((own, tags))
    vocabulary = sorted({w for own, _ in spliced for w in own})
    place = {w: i for i, w in enumerate(vocabulary)}
    every, sizes = model.features(vocabulary)
    features = np.split(every, np.cumsum(sizes)[:-1])
    grads = [np.zeros_like(x) for x in (model.emit, model.move, model.begin)]
    for epoch in range(epochs):
        order = draw.permutation(len(spliced))
        for part in np.array_split(order, max(1, len(spliced) // 64)):
            chosen = [spliced[i] for i in part]
            lengths = np.array([len(own) for own, _ in chosen])
            kinds = np.unique([place[w] for own, _ in chosen for w in own])
            flat = np.concatenate([features[k] for k in kinds])
            starts = np.cumsum([0, *(len(features[k]) for k in kinds[:-1])])
            table = np.add.reduceat(model.emit[flat], starts)
            at = np.zeros((len(chosen), lengths.max()), dtype=int)
            gold = np.zeros((*at.shape, n))
            moved, begun = np.zeros((n, n)), np.zeros(n)
            for r, (own, tags) in enumerate(chosen):
                at[r, : len(own)] = np.searchsorted(kinds, [place[w] for w in own])
                gold[r, np.arange(len(tags)), tags] = 1
                np.add.at(moved, (tags[:-1], tags[1:]), 1)
                begun[tags[0]] += 1
            gamma, moves = forward_backward(table[at], lengths, model.move, model.begin)
            inside = np.arange(at.shape[1])[None, :] < lengths[:, None]
            error = np.zeros((len(kinds), n))
            np.add.at(error, at[inside], (gold - gamma)[inside])
            emit = np.zeros_like(model.emit)
            np.add.at(emit, flat, np.repeat(error, [len(features[k]) for k in kinds], axis=0))
            for weight, held, step in zip((model.emit, model.move, model.begin), grads, (emit, moved - moves, begun - gamma[:, 0].sum(0)), strict=True):
                step = step / len(chosen) - 1e-4 * weight
                held += step * step
                weight += 0.5 * step / (np.sqrt(held) + 1e-6)
    return model


def learn(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    docs_per_lang: int = 500,
    passage: int = 2_000,
    bits: int = 15,
    lexicon_words: int = 300,
    sequences: int = 3_000,
    epochs: int = 6,
    seed: int = 1,
) -> Model:
    """Fit on rows of ``docs`` with a text and a language; these are the labelled rows, all of them.

    What the driver receives are about ``docs_per_lang`` passages of ``passage`` characters for each
    language, however many rows there are: each distinct text is drawn with the same probability by
    a hash, and once, however often it is repeated; a language of fewer texts gives them all.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    labelled = labelled.withColumn("_code", F.xxhash64(F.lit(seed), "_text"))
    sizes = {r["_lang"]: r["count"] for r in labelled.select("_lang", "_code").distinct().groupBy("_lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0), [], 0)
    share = F.lit(0.0)
    for lang, distinct in sizes.items():
        share = F.when(F.col("_lang") == lang, F.lit(docs_per_lang / distinct)).otherwise(share)
    uniform = F.col("_code").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "_text"), F.greatest(F.lit(1), F.char_length("_text") - passage + 1))
    drawn = labelled.where(uniform < share).select("_lang", "_code", F.substring("_text", (start + 1).cast("int"), F.lit(passage)).alias("_passage"))
    passages: dict[str, list[str]] = {lang: [] for lang in sizes}
    for r in drawn.groupBy("_lang", "_code").agg(F.min("_passage").alias("_passage")).collect():
        passages[r["_lang"]].append(r["_passage"])
    return fit({k: sorted(v) for k, v in passages.items()}, bits=bits, lexicon_words=lexicon_words, sequences=sequences, epochs=epochs, seed=seed)


class Tagger:
    """Word scores of one model, of which up to ``held`` words are kept."""

    def __init__(self, model: Model, held: int = 200_000):
        self.model, self.held = model, held
        self.place: dict[str, int] = {}
        self.table = np.zeros((held, len(model.labels)), dtype=np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """words x labels scores."""
        get = self.place.get
        at = np.array([get(w, -1) for w in words], dtype=np.int64)
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return self.table[at]
        fresh = {w: k for k, w in enumerate(dict.fromkeys(words[i] for i in missing))}
        scores = self.model.scores(list(fresh)).astype(np.float32)
        out = self.table[at]
        out[missing] = scores[[fresh[words[i]] for i in missing]]
        kept = min(len(fresh), self.held - len(self.place))
        self.table[len(self.place) : len(self.place) + kept] = scores[:kept]
        self.place.update(zip(islice(fresh, kept), count(len(self.place)), strict=False))
        return out

    def masses(self, texts: list[str | None], slab: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
        """Label mass of each text, and its number of words.

        Texts go through in slabs of about ``slab`` characters (at least one text), so the words held
        at once are bounded by the longest text, not by the rows of a batch.
        """
        mass, counts = np.zeros((len(texts), len(self.model.labels))), np.zeros(len(texts), dtype=np.int64)
        begin, size = 0, 0
        for end, text in enumerate([*texts, None]):
            if end == len(texts) or end > begin and size + len(text or "") > slab:
                mass[begin:end], counts[begin:end] = self._slab(texts[begin:end])
                begin, size = end, 0
            size += len(text or "")
        return mass, counts

    def _slab(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        words = [WORD.findall(t.lower()) if t else [] for t in texts]
        counts = np.array([len(w) for w in words], dtype=np.int64)
        mass = np.zeros((len(texts), len(self.model.labels)))
        some = np.flatnonzero(counts)
        if len(some) and self.model.labels:
            scores = self.rows([w for own in words for w in own])
            mass[some] = label_mass(scores, counts[some], self.model.move, self.model.begin)
        return mass, counts


_TAGGERS: dict[str, Tagger] = {}


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", prefix: str = "_") -> DataFrame:
    """Every row of ``docs`` with lang_pred, score and n_words, their names after ``prefix``.

    Null texts, and texts without a letter, are ``und`` with score 0, as is everything where no
    language was learned. All words of a text count, however many; repeated rows get equal results; an
    empty table gives an empty result. Other columns pass unchanged, but columns of ``docs`` that have
    a result's name are replaced by it; ``free_prefix`` gives a prefix that meets none.
    """
    model.key = xxhash.xxh64_hexdigest(model.emit.tobytes() + "|".join(model.labels).encode())
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, n_words bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = sent.value
        if own.key not in _TAGGERS:
            _TAGGERS.clear()
            _TAGGERS[own.key] = Tagger(own)
        names = np.array([*own.labels, UNKNOWN], dtype=object)
        for texts in batches:
            mass, counts = _TAGGERS[own.key].masses([t if isinstance(t, str) else None for t in texts])
            if not own.labels:
                mass = np.zeros((len(texts), 1))
            known = (counts > 0) & bool(own.labels)
            best = np.where(known, mass.argmax(1), len(own.labels))
            score = np.where(known, mass.max(1) / np.maximum(counts, 1), 0.0)
            yield pd.DataFrame({"lang": names[best], "score": np.clip(score, 0, 1), "n_words": counts})

    tagged = f"{free_prefix(docs)}tagged"
    out = docs.withColumn(tagged, run(F.col(text_col)))
    return out.withColumns({f"{prefix}{name}": F.col(tagged)[field] for name, field in (("lang_pred", "lang"), ("score", "score"), ("n_words", "n_words"))}).drop(tagged)
