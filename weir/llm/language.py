"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, inner character n-grams and membership in lexicons learned
from the training rows; transitions between the languages of neighbouring words are learned too.
Forward-backward gives every word of a text a probability for each language, so code-switched
text gets its words labelled; a document's language is the one with most mass.
"""

from __future__ import annotations

import random
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.common import CACHE_BYTES, kept

#: Hashed features.
BUCKETS = 1 << 15
#: Labelled rows that the fit gathers at most (all languages together), and characters of one.
SAMPLE_ROWS = 1200
SAMPLE_CHARS = 20_000
#: Words of a text that are handled in one step each; a longer text is several stretches of one chain.
CHAIN = 256
#: Longer white-space tokens (paragraphs of scripts without spaces) are cut into words of so many characters.
WORD_CHARS = 40
LEXICON = 400
#: Words that are handled together, and bytes that a kept word costs besides its letters, about.
GROUP_WORDS = 100_000
WORD_BYTES = 300
UNDETERMINED = "und"


def core(token: str) -> str:
    """Lower-cased, without what isn't a letter at either end; empty if it has no letter."""
    token = token.lower()
    if token.isalpha():
        return token
    s, e = 0, len(token)
    while s < e and not token[s].isalpha():
        s += 1
    while e > s and not token[e - 1].isalpha():
        e -= 1
    return token[s:e]


def words_of(text: str) -> list[str]:
    """White-space tokens, none over WORD_CHARS characters."""
    tokens = text.split()
    if max(map(len, tokens), default=0) <= WORD_CHARS:
        return tokens
    return [t[p : p + WORD_CHARS] for t in tokens for p in range(0, len(t), WORD_CHARS)]


def features(word: str, lexicons: dict[str, int]) -> list[int]:
    """Feature numbers of a core."""
    w = f"^{word}$"
    names = [f"p{word[:2]}", f"s{word[-2:]}", f"s{word[-4:]}", f"l{lexicons.get(word, 0)}", *[w[i : i + 3] for i in range(len(w) - 2)]]
    return [zlib.crc32(x.encode("utf-8", "replace")) & BUCKETS - 1 for x in names]


@dataclass
class Model:
    labels: list[str]
    lexicons: dict[str, int]  # word to the bits of the languages that have it
    weights: np.ndarray  # buckets x labels
    transitions: np.ndarray  # log potentials, labels x labels
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of the feature scores, the largest of a word being 1."""
        lists = [features(w, self.lexicons) for w in words]
        flat = np.fromiter((x for f in lists for x in f), dtype="int64")
        starts = np.cumsum([0, *(len(f) for f in lists[:-1])])
        scores = np.add.reduceat(self.weights[flat], starts, axis=0)
        return np.exp(scores - scores.max(1, keepdims=True)).astype("float32")


def _forward_backward(e: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of chains x words x labels, and expected transitions; potentials e and m."""
    s, t, k = e.shape
    alpha, beta, scale = np.empty_like(e), np.empty_like(e), np.empty((s, t, 1), e.dtype)
    a = e[:, 0]
    for i in range(t):
        a = a if i == 0 else (a @ m) * e[:, i]
        scale[:, i] = a.sum(1, keepdims=True)
        a = alpha[:, i] = a / scale[:, i]
    b = beta[:, -1] = np.ones((s, k), e.dtype)
    pairs = np.zeros((k, k))
    for i in range(t - 1, 0, -1):
        w = b * e[:, i] / scale[:, i]
        pairs += (alpha[:, i - 1].T @ w) * m
        b = beta[:, i - 1] = w @ m.T
    return alpha * beta, pairs


def fit(rows: list[tuple[str, str]], rounds: int = 40, seed: int = 7) -> Model:
    """Learns from (text, language). Chains are spliced from pieces of different documents, so
    that transitions are learned from language switches as well."""
    rng = random.Random(seed)
    labels = sorted({lang for _, lang in rows})
    number = {lang: i for i, lang in enumerate(labels)}
    texts = [([c for c in map(core, words_of(t)) if c], number[lang]) for t, lang in rows]
    counts = [Counter() for _ in labels]
    for words, lang in texts:
        counts[lang].update(words)
    lexicons: dict[str, int] = {}
    for lang, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons[w] = lexicons.get(w, 0) | 1 << lang
    pieces = [[] for _ in labels]
    for words, lang in texts:
        p = 0
        while p < len(words):
            n = rng.randint(6, 30)
            pieces[lang].append(words[p : p + n])
            p += n
    k, length = len(labels), 40
    model = Model(labels, lexicons, np.zeros((BUCKETS, k)), np.zeros((k, k)))
    if not any(pieces):
        return model
    most = 60_000 // max(1, k)
    stream: list[tuple[str, int]] = []
    for lang in range(k):  # equally many words of each language
        rng.shuffle(pieces[lang])
        have = 0
        kept = []
        for x in pieces[lang]:
            if have >= most:
                break
            kept.append(x)
            have += len(x)
        pieces[lang] = kept
    mixed = [(x, lang) for lang in range(k) for x in pieces[lang]]
    rng.shuffle(mixed)
    for x, lang in mixed:
        stream += [(w, lang) for w in x]
    while len(stream) < length:
        stream += stream
    vocabulary: dict[str, int] = {}
    ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w, _ in stream])
    gold = np.array([lang for _, lang in stream])
    s = len(stream) // length
    ids, gold = ids[: s * length].reshape(s, length), gold[: s * length].reshape(s, length)
    lists = [features(w, lexicons) for w in vocabulary]
    flat, sizes = np.array([x for f in lists for x in f]), np.array([len(f) for f in lists])
    starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(lists)), sizes)
    v = len(lists)
    seen = np.eye(k)[gold]
    pairs_seen = np.zeros((k, k))
    np.add.at(pairs_seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.transitions)]
    for step in range(1, rounds + 1):
        scores = np.add.reduceat(model.weights[flat], starts, axis=0)
        e = np.exp(scores - scores.max(1, keepdims=True))[ids]
        post, pairs = _forward_backward(e, np.exp(model.transitions))
        diff = (post - seen).reshape(-1, k)
        by_word = np.stack([np.bincount(ids.ravel(), diff[:, i], v) for i in range(k)], 1)
        grad_w = np.stack([np.bincount(flat, by_word[owner, i], BUCKETS) for i in range(k)], 1) / s + 1e-4 * model.weights
        grad_t = (pairs - pairs_seen) / s + 1e-3 * model.transitions
        for p, g, (m1, m2) in zip((model.weights, model.transitions), (grad_w, grad_t), state):  # Adam
            m1 += 0.1 * (g - m1)
            m2 += 0.02 * (g * g - m2)
            p -= 0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.98**step)) + 1e-8)
    model.weights = model.weights.astype("float32")
    return model


class Labeller:
    """Applies a model; keeps the emissions of words by worker."""

    def __init__(self, model: Model) -> None:
        self.model, self.m = model, np.exp(model.transitions).astype("float32")
        self.clear()

    def clear(self) -> None:
        self.rows: dict[str, int] = {}  # token to its row
        self.cores: dict[str, int] = {"": 0}
        self.e = np.ones((1, len(self.model.labels)), "float32")  # row 0: no letter
        self.held = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.held > CACHE_BYTES:
            self.clear()
        tokens = [words_of(t) for t in texts]
        found = [list(map(self.rows.get, x)) for x in tokens]
        new: dict[str, int] = {}
        for x, got in zip(tokens, found):
            if None in got:
                for i, r in enumerate(got):
                    if r is None:
                        w = x[i]
                        if (r := self.rows.get(w)) is None:
                            c = core(w)
                            if (r := self.cores.get(c)) is None:
                                r = self.cores[c] = len(self.e) + len(new)
                                new[c] = r
                            self.rows[w] = r
                            self.held += WORD_BYTES + len(w)
                        got[i] = r
        if new:
            grown = self.model.emissions(list(new))
            self.e = np.concatenate([self.e, grown])
        return [np.array(x, dtype="int64") for x in found]

    def posteriors(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its words' label probabilities; row 0 of e marks words without letters."""
        ids = self.encode(texts)
        chains = [(d, p, min(CHAIN, len(x) - p)) for d, x in enumerate(ids) for p in range(0, len(x), CHAIN)]
        chains.sort(key=lambda c: -c[2])
        out = [np.empty((len(x), len(self.model.labels)), "float32") for x in ids]
        if not chains:
            return out
        size, t = np.array([c[2] for c in chains]), chains[0][2]
        live = [int((size > i).sum()) for i in range(t)]
        word = np.zeros((len(chains), t), "int64")
        for j, (d, p, n) in enumerate(chains):
            word[j, :n] = ids[d][p : p + n]
        before, after, parts = self._borders(chains, word, size)
        alphas, scales = [], []
        for i in range(t):
            e = self.e[word[: live[i], i]]
            a = e * before if i == 0 else (alphas[-1][: live[i]] @ self.m) * e
            z = a.sum(1, keepdims=True)
            alphas.append(a / z)
            scales.append((e, z))
        post = np.empty((len(chains), t, len(self.model.labels)), "float32")
        b = after[: live[-1]]
        for i in range(t - 1, -1, -1):
            if i < t - 1:
                e, z = scales[i + 1]
                b = ((b * e / z) @ self.m.T)
                if live[i] > len(b):
                    b = np.concatenate([b, after[len(b) : live[i]]])
            post[: live[i], i] = alphas[i] * b
        for j, (d, p, n) in enumerate(chains):
            out[d][p : p + n] = post[j, :n] / post[j, :n].sum(1, keepdims=True) if j in parts else post[j, :n]
        for d, x in enumerate(ids):  # words without letters have no language
            out[d][x == 0] = 0
        return out

    def _borders(self, chains: list[tuple[int, int, int]], word: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, set[int]]:
        """What the words before a stretch say of its first label, what those after it say of its
        last one, and which stretches are parts of longer texts. Each part is brought down to one
        matrix, and messages pass through these, so a text of any length is one chain, exactly."""
        k = self.m.shape[0]
        before, after = np.ones((len(chains), k), "float32"), np.ones((len(chains), k), "float32")
        long = {d for d, p, _ in chains if p}
        parts = [j for j, c in enumerate(chains) if c[0] in long]
        if not parts:
            return before, after, set()
        w, n, m = word[parts], size[parts], self.m.astype("float64")
        f = np.eye(k) * self.e[w[:, 0]].astype("float64")[:, None, :]
        for i in range(1, int(n[0])):
            live = int((n > i).sum())
            g = (f[:live].reshape(-1, k) @ m).reshape(live, k, k) * self.e[w[:live, i]][:, None, :]
            f[:live] = g / g.max((1, 2), keepdims=True)
        order = sorted(range(len(parts)), key=lambda i: chains[parts[i]][:2])
        for i in order:
            x = x if chains[parts[i]][1] else np.ones(k)
            before[parts[i]] = x
            x = x @ f[i] @ m
            x /= x.sum()
        last = None
        for i in reversed(order):
            d = chains[parts[i]][0]
            x = x if d == last else np.ones(k)
            after[parts[i]], last = x, d
            x = m @ (f[i] @ x)
            x /= x.sum()
        return before, after, set(parts)

    def documents(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        """(language, score, words with letters, switches between words) of each text."""
        res = []
        for post in self.posteriors([t or "" for t in texts]):
            real = post[post.sum(1) > 0]
            if not len(real) or not self.model.labels:
                res.append((UNDETERMINED, 0.0, 0, 0))
                continue
            mass = real.sum(0, dtype="float64")
            best = int(mass.argmax())
            tags = real.argmax(1)
            res.append((self.model.labels[best], float(min(1.0, mass[best] / mass.sum())), len(real), int((tags[1:] != tags[:-1]).sum())))
        return res


def labeller(shared) -> Labeller:
    """One for each worker process and broadcast model."""
    return kept(("labeller", shared.value.uid), lambda: Labeller(shared.value))


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most `rows` labelled rows by a hash of their id, languages in about equal numbers.

    A language's rows get keys uniform up to its count; the smallest keys win, so each language
    has the same chance. A first pass finds the largest key that wins, so that the second sends no
    more texts than are taken (and ties): no sort, no full shuffle.
    """
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= SAMPLE_CHARS) & (F.coalesce(remainder(4), F.lit(0)) != 2))
    counts = train.groupBy("lang").agg(F.count(F.lit(1)).alias("weight"))
    weights = {r.lang: r.weight for r in counts.orderBy(F.desc("weight"), "lang").limit(rows).toLocalIterator()}
    if not weights:
        return []
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("lang")]
    key = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 12).cast("double") * weight
    keyed = train.select(key.alias("key"), "text", "lang").where("key is not null")
    keys = [r.key for r in keyed.select("key").orderBy("key").limit(rows).collect()]
    if not keys:
        return []
    top = keyed.where(F.col("key") <= keys[-1]).orderBy("key", "lang", "text").limit(rows)
    return [(r.text, r.lang) for r in top.collect()]


def trained(docs: DataFrame):
    return docs.sparkSession.sparkContext.broadcast(fit(sample(docs)))


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def identify(docs: DataFrame, model=None) -> DataFrame:
    """PREDICTED for every row: language, its share of the words' probability, words with letters
    (of a token over WORD_CHARS characters its pieces), and how often the likeliest language changes from word to word. Null, empty and letterless
    texts are `und` with score 0. model: a broadcast Model; else one is fitted on docs."""
    shared = model or trained(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = labeller(shared)
        names = [x.split()[0] for x in PREDICTED.split(", ")]
        for batch in batches:
            for part, texts in by_words(batch):
                cols = list(zip(*use.documents(texts)))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder(4) == 2, F.lit(False)), F.col("text").cast("string")).mapInArrow(run, PREDICTED)


def by_words(batch: pa.RecordBatch, at: int = 2) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of a batch of about GROUP_WORDS words."""
    texts, held, start = batch.column(at).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") // 6
        if held >= GROUP_WORDS or i == len(texts) - 1:
            yield batch.slice(start, i + 1 - start), texts[start : i + 1]
            held, start = 0, i + 1


def accept(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that have no letter, or whose language has less than `least` of the
    words' probability; lang becomes the predicted one. Other columns stay. Null and empty texts have
    no letter; repeated rows are judged alike; a null lang doesn't matter; an empty table stays empty."""
    shared, schema = trained(docs), docs.schema
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = labeller(shared)
        for batch in batches:
            for part, texts in by_words(batch, text):
                got = use.documents(texts)
                cols = [pa.array([g[0] for g in got], part.column(lang).type) if i == lang else c for i, c in enumerate(part.columns)]
                keep = pa.array([g[0] != UNDETERMINED and g[1] >= least for g in got], pa.bool_())
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names).filter(keep)

    return docs.mapInArrow(run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
