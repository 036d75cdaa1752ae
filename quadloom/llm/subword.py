"""Bags of hashed words and character n-grams, embedded, averaged and put through a softmax.

Two operators rest on this: quality (one bag per document) and toxicity (that, and one bag per
window of words, the worst window speaking for the document). Embeddings and softmax are learnt
together by stochastic gradient descent (Adagrad steps) in numpy on the driver, from a bounded
sample. Features that fewer than MIN_DOCS of its documents hold weigh nothing, so neither chance
finds of one document nor features never seen add noise to a score.

The softmax is linear in the average, so for scoring each head folds into one number a feature,
its embedding times the difference of the two output rows. A word's features then fold into a
count and a sum for each head, which workers keep by word; nothing of the text is skipped.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import xxhash

from quadloom.llm.common import mix64, one_thread

GRAMS = (3, 4, 5)
CACHE_WORDS = 150_000
CHUNK_WORDS = 20_000
#: Features of fewer documents of the sample weigh nothing.
MIN_DOCS = 5
#: Steps that averages over whole texts are learnt in at least; a small sample is gone through more often.
LEAST_STEPS = 600
#: No text has this as a word, as words hold no tab.
AGAIN = "\t="


class Features:
    """words -> hashed feature ids: the whole word and every n-gram of <word>, by code points."""

    def __init__(self, buckets: int, fold_case: bool):
        self.buckets, self.fold_case = buckets, fold_case

    def split(self, text: str | None) -> list[str]:
        """Words between ASCII white space; null and empty texts have none.

        A word that repeats the one before it becomes AGAIN, so stuttering is one feature of its
        own, learnt for all words at once, and a stuttered word weighs no more than a single one.
        """
        if not text:
            return []
        data = text.encode("utf-8", "replace")
        joined = b" ".join((data.lower() if self.fold_case else data).split()).decode("utf-8")
        words = joined.split(" ") if joined else []
        return [w if w != v else AGAIN for v, w in zip(["", *words], words)]

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature ids of all words one after another, and where each word's begin (one more at the end)."""
        parts = [self._some(words[i : i + CHUNK_WORDS]) for i in range(0, len(words), CHUNK_WORDS)]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])

    def _some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of a few words at a time, as the arrays below are many times their size: ids, and counts by word."""
        n = len(words)
        marked = [f"<{w}>" for w in words]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        length = np.fromiter(map(len, marked), np.int64, n)
        owner_of_point = np.repeat(np.arange(n, dtype=np.int32), length)
        room = np.repeat(np.cumsum(length), length) - np.arange(len(points))
        ids = [np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, n)]
        owners = [np.arange(n, dtype=np.int32)]
        rolling = np.zeros(len(points), np.uint64)
        for k in range(min(max(GRAMS), len(points))):  # one word of one character has three points
            rolling[: len(points) - k] = rolling[: len(points) - k] * np.uint64(0x100000001B3) + points[k:] + np.uint64(k + 1)
            if k + 1 in GRAMS:
                at = np.flatnonzero(room > k)
                ids.append(mix64(rolling[at] + np.uint64((k + 1) << 56)))
                owners.append(owner_of_point[at])
        owner = np.concatenate(owners)
        flat = (np.concatenate(ids) % np.uint64(self.buckets)).astype(np.int32)
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)


@dataclass(frozen=True)
class Head:
    """How one softmax reads a text, and how it is trained.

    window > 0: the highest of the averages over windows of so many words; window = 0: the average
    over the text, with `prior` features of weight nothing added, so that a text of a few words
    isn't judged by them alone.
    """

    window: int = 0
    prior: float = 0.0
    epochs: int = 12
    rate: float = 0.4


@dataclass
class Model:
    """Fitted heads, folded for scoring. A text's score is the chance that one head at least is right to say 1."""

    buckets: int
    fold_case: bool
    heads: list[Head]
    weight: np.ndarray  # by feature and head
    bias: np.ndarray  # by head
    cache: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"cache": {}}

    def _fill(self, words: set[str]) -> None:
        new = list(words)
        flat, starts = Features(self.buckets, self.fold_case).of(new)
        sums = np.add.reduceat(self.weight[flat].astype(np.float64), starts[:-1], axis=0)
        self.cache.update(zip(new, np.column_stack([np.diff(starts), sums]).tolist()))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1 by text; texts without words get the biases alone."""
        return 1 - np.prod(1 - self.by_head(texts), axis=1)

    def by_head(self, texts: list[str | None]) -> np.ndarray:
        split = Features(self.buckets, self.fold_case).split
        cache, out = self.cache, np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        for i, text in enumerate(texts):
            words = split(text)
            if not words:
                continue
            if len(cache) > CACHE_WORDS:
                cache.clear()
            if missing := set(words).difference(cache):
                self._fill(missing)
            held = np.array([cache[w] for w in words]).T
            for h, head in enumerate(self.heads):
                counts, sums = held[0], held[h + 1]
                if not head.window or len(words) <= head.window:
                    out[i, h] += sums.sum() / (counts.sum() + head.prior)
                else:
                    a, b = spans(len(words), head.window)
                    s, c = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(counts)])
                    out[i, h] += ((s[b] - s[a]) / (c[b] - c[a] + head.prior)).max()
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def spans(n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows that overlap by half and cover n words to the last."""
    a = np.arange(0, max(1, n - window // 2), window // 2)
    return a, np.minimum(a + window, n)


def fit(texts: list[str | None], labels: list[int], heads: list[Head], *, buckets: int = 1 << 18, dim: int = 16, fold_case: bool = True, batch: int = 64, seed: int = 7, unknown: float = 0.5, share: float | None = None) -> Model:
    """Learn embeddings and softmax of each head together.

    One class gives a constant model, no rows one that says `unknown`. share: how often label 1 is
    in the rows that the sample stands for; heads that average over whole texts are set to it, as
    their probabilities are otherwise those of the sample, which may hold more of the rarer class.
    """
    features = Features(buckets, fold_case)
    vocabulary: dict[str, int] = {}
    docs, marks = [], []
    for text, mark in zip(texts, labels):
        if words := features.split(text):
            docs.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words), np.int32, len(words)))
            marks.append(int(mark))
    y = np.array(marks, np.int64)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(np.mean(labels)) if len(labels) else unknown, 1e-3), 1 - 1e-3)
        return Model(buckets, fold_case, [Head()], np.zeros((buckets, 1), np.float32), np.array([np.log(share / (1 - share))]))
    flat, starts = features.of(list(vocabulary))
    del vocabulary
    held = np.zeros(buckets, np.int32)
    for words in docs:
        held[np.unique(expand(np.unique(words), flat, starts)[0])] += 1
    known = held >= min(MIN_DOCS, len(docs))
    with one_thread():
        learnt = [(_windows if head.window else _averages)(docs, y, flat, starts, known, head, dim, batch, np.random.default_rng(seed)) for head in heads]
    weight = np.stack([w for w, _ in learnt], axis=1)
    weight[~known] = 0
    bias = np.array([b for _, b in learnt])
    if share is not None:
        odds = lambda p: np.log(p / (1 - p))
        bias += np.where([h.window == 0 for h in heads], odds(share) - odds(y.mean()), 0.0)
    return Model(buckets, fold_case, list(heads), weight, bias)


def best_heads(texts: list[str | None], labels: list[int], heads: list[Head], threshold: float, **options) -> list[Head]:
    """Those heads that together do best on every fifth row of the sample when learnt from the others.

    Best: by recall plus specificity at the threshold; of equal ones, the most heads. With under
    ten of these rows in either class there is nothing to choose by, and all heads are taken.
    """
    marks = np.array(labels, np.int64)
    held = np.arange(len(marks)) % 5 == 0
    if len(heads) < 2 or min(np.bincount(marks[held], minlength=2)) < 10 or len(set(marks[~held])) < 2:
        return heads
    rest, own = [t for t, h in zip(texts, held) if not h], [t for t, h in zip(texts, held) if h]
    model = fit(rest, marks[~held].tolist(), heads, **options)
    if len(model.heads) < len(heads):  # the texts of one class have no words
        return heads
    each, y = model.by_head(own), marks[held]
    subsets = [[h for h in range(len(heads)) if bits >> h & 1] for bits in range(1, 1 << len(heads))]

    def worth(some: list[int]) -> tuple[float, int]:
        said = 1 - np.prod(1 - each[:, some], axis=1) >= threshold
        return round(said[y == 1].mean() + 1 - said[y == 0].mean(), 9), len(some)

    return [heads[h] for h in max(subsets, key=worth)]


class _Learner:
    """Embeddings and softmax of one head, and the Adagrad step."""

    def __init__(self, buckets: int, dim: int, y: np.ndarray, head: Head, rng: np.random.Generator):
        self.embed = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        self.softmax = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
        self.bias = np.log(np.bincount(y, minlength=2) / len(y)).astype(np.float32)
        self.seen, self.seen_w = np.full(buckets, 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32)
        self.head, self.place = head, np.zeros(buckets, np.int32)

    def distinct(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As np.unique with the inverse, by marking buckets instead of sorting."""
        mark = np.zeros(len(self.place), bool)
        mark[feature] = True
        ids = np.flatnonzero(mark)
        self.place[ids] = np.arange(len(ids))
        return ids, self.place[feature]

    def folded(self) -> np.ndarray:
        return self.embed @ (self.softmax[:, 1] - self.softmax[:, 0])

    def step(self, epoch: int, row: np.ndarray, feature: np.ndarray, share: np.ndarray, y: np.ndarray) -> None:
        """One batch: bag row holds feature with this share of its average."""
        step = self.head.rate * (1 - epoch / self.head.epochs) + 0.02
        ids, at = self.distinct(feature)
        bags = np.zeros((len(y), len(ids)), np.float32)
        if self.head.window:  # a window's features repeat, an average's don't
            np.add.at(bags, (row, at), share)
        else:
            bags[row, at] = share
        mean = bags @ self.embed[ids]
        logit = mean @ self.softmax + self.bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g, g_soft = bags.T @ (p @ self.softmax.T), mean.T @ p / len(y)
        self.seen[ids] += (g * g).mean(axis=1)
        self.embed[ids] -= step * g / np.sqrt(self.seen[ids])[:, None]
        self.seen_w += g_soft * g_soft
        self.softmax -= step * 0.5 * g_soft / np.sqrt(self.seen_w)
        self.bias -= step * 0.2 * p.mean(axis=0)

    def result(self) -> tuple[np.ndarray, float]:
        return self.folded(), float(self.bias[1] - self.bias[0])


def _averages(docs, y, flat, starts, known, head: Head, dim: int, batch: int, rng) -> tuple[np.ndarray, float]:
    """Each step averages over all words of each document, as scoring does, held as distinct features with their shares."""
    bags = []
    for words in docs:
        own, times = np.unique(words, return_counts=True)
        f, edge = expand(own, flat, starts)
        ids, at = np.unique(f, return_inverse=True)
        share = np.bincount(at, np.repeat(times, np.diff(edge)))
        share /= share.sum() + head.prior
        bags.append((ids[known[ids]], share[known[ids]].astype(np.float32)))
    head = replace(head, epochs=max(head.epochs, LEAST_STEPS * batch // len(bags)))
    learner = _Learner(len(known), dim, y, head, rng)
    for epoch in range(head.epochs):
        order = rng.permutation(len(bags))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            row = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])
            learner.step(epoch, row, np.concatenate([bags[i][0] for i in chosen]), np.concatenate([bags[i][1] for i in chosen]), y[chosen])
    return learner.result()


def _windows(docs, y, flat, starts, known, head: Head, dim: int, batch: int, rng) -> tuple[np.ndarray, float]:
    """Each step takes, of each document, the window that the present model scores highest (in the
    first epochs, of one labelled 0, at times a random one), so a label that a few words earn isn't
    thinned out by the rest of a long text."""
    size = np.diff(starts)
    learner = _Learner(len(known), dim, y, head, rng)
    for epoch in range(head.epochs):
        order = rng.permutation(len(docs))
        for first in range(0, len(order), batch):
            chosen = order[first : first + batch]
            folded = learner.folded() * known
            bags = []
            for i in chosen:
                words = docs[i]
                if len(words) > head.window:
                    a, b = spans(len(words), head.window)
                    if epoch < 2 and rng.random() < 0.5 and y[i] == 0:
                        k = rng.integers(len(a))
                    else:
                        own, at = np.unique(words, return_inverse=True)
                        f, s = expand(own, flat, starts)
                        sums = np.add.reduceat(folded[f], s[:-1])[at]
                        cs, cn = np.concatenate([[0], np.cumsum(sums)]), np.concatenate([[0], np.cumsum(size[words])])
                        k = int(((cs[b] - cs[a]) / (cn[b] - cn[a] + head.prior)).argmax())
                    words = words[a[k] : b[k]]
                bags.append(words)
            features = [expand(words, flat, starts)[0] for words in bags]
            row = np.repeat(np.arange(len(chosen)), [len(f) for f in features])
            share = np.repeat([1 / (len(f) + head.prior) for f in features], [len(f) for f in features])
            feature = np.concatenate(features)
            keep = known[feature]
            learner.step(epoch, row[keep], feature[keep], share[keep].astype(np.float32), y[chosen])
    return learner.result()


def expand(words: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of these words one after another, and where each word's begin."""
    n = starts[words + 1] - starts[words]
    edge = np.concatenate([[0], np.cumsum(n)])
    return flat[np.arange(edge[-1]) - np.repeat(edge[:-1] - starts[words], n)], edge
