"""Plain versions of operators, in loops over single texts, that tests hold the operators against."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import groupby

import numpy as np


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# quality classifier


def shape(word):
    kind = lambda c: "A" if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else "0" if re.fullmatch(r"\d", c) else "a" if re.fullmatch(r"[^\W_]", c) else c
    return "~" + "".join(k for k, _ in groupby(map(kind, word)))


def terms(text):
    words = text.split()
    counts = Counter(x for w in words for x in (shape(w), w.lower()))
    counts["~again"] = sum(a == b for a, b in zip(words, words[1:]))
    return {t: n / len(words) for t, n in counts.items() if n}


class Quality:
    """Latent-semantic neighbours by a full singular value decomposition in double precision."""

    def __init__(self, docs, labels, n_terms=2048, dims=48, k=15):
        self.k = k
        sample = sorted((i, t, labels[i]) for i, t in docs if labels.get(i) is not None and not held_out(i))
        found = [terms(t) for _, t, _ in sample]
        seen = Counter(x for f in found for x in f)
        n = len(sample)
        self.names = sorted((t for t, c in seen.items() if c >= max(2, n // 1000)), key=lambda t: (-seen[t], t.encode()))[:n_terms]
        self.at = {t: j for j, t in enumerate(self.names)}
        self.idf = np.array([math.log((n + 1) / (seen[t] + 0.5)) + 0.1 for t in self.names])
        x = np.array([self.weigh(f) for f in found])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        self.basis = np.linalg.svd(x, full_matrices=False)[2][:dims].T
        self.vectors = self.unit(x @ self.basis)
        self.labels = np.array([y for _, _, y in sample], float)

    def weigh(self, found):
        out = np.zeros(len(self.names))
        for t, share in found.items():
            if t in self.at:
                out[self.at[t]] = math.sqrt(share) * self.idf[self.at[t]]
        return out

    @staticmethod
    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)

    def bounds(self, text, slack=3e-5):
        """The least and the greatest score if neighbours within ``slack`` of the k-th count or not."""
        own = self.weigh(terms(text))
        if not own.any():
            return (float(self.labels.mean()),) * 2
        cosine = self.vectors @ self.unit(own @ self.basis)
        kth = np.sort(cosine)[-min(self.k, len(cosine))]
        weight = np.maximum(cosine, 0) ** 4
        sure, open_ = cosine > kth + slack, np.abs(cosine - kth) <= slack
        total = lambda mask, y: float(weight[mask & (self.labels == y)].sum())
        good, bad, more, less = total(sure, 1), total(sure, 0), total(open_, 1), total(open_, 0)
        if good + bad + more + less == 0:
            return (float(self.labels.mean()),) * 2
        return good / max(good + bad + less, 1e-12), (good + more) / max(good + bad + more, 1e-12)


# toxicity


def toxic_score(model, text):
    """Every word against every entry of the lexicon, one by one."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    fits = lambda entry, w: w == entry[:-1] if entry[-1] == "$" else w.startswith(entry[:-1]) and len(w) > len(entry) - 1
    hit = Counter(w for w in words if any(fits(e, w) for e in model.lexicon))
    z = model.bias + sum(model.weights[j] for e, j in model.lexicon.items() if any(fits(e, w) for w in hit))
    n = len(model.lexicon)
    if not hit:
        z += model.weights[n + 6]
    else:
        rates = [k for k, r in enumerate((0.002, 0.005, 0.01, 0.02, 0.05)) if sum(hit.values()) >= r * len(words)]
        z += sum(model.weights[n + k] for k in rates) if rates else model.weights[n + 5]
    return 1 / (1 + math.exp(-z))


def toxic_posteriors(votes, seen, lexicon, prior, trust, rounds):
    """Expectation-maximisation with correlated voters, entry by entry."""
    rows, voters = len(votes), len(votes[0])
    post = []
    for v in votes:
        met = sum(v[:lexicon])
        post.append(0.9 if met >= 2 else 0.5 if met else 0.02)
    belief = trust * rows / 2
    for _ in range(rounds):
        weight = [[1 - p for p in post], list(post)]
        chance = [[(sum(w * v[j] for w, v in zip(weight[c], votes)) + belief * seen[c][j] + 0.25) / (sum(weight[c]) + belief + 0.5) for j in range(voters)] for c in (0, 1)]
        share = 0.5 * sum(post) / rows + 0.5 * prior
        ratio = [math.log(chance[1][j] / chance[0][j]) for j in range(voters)]
        ratio = [max(r, 0) if j < lexicon else r for j, r in enumerate(ratio)]

        def correlation(i, j):
            if i == j:
                return 0.0
            best = 0.0
            for c in (0, 1):
                total = max(sum(weight[c]), 1e-9)
                cov = lambda a, b: sum(w * (v[a] - chance[c][a]) * (v[b] - chance[c][b]) for w, v in zip(weight[c], votes)) / total  # noqa: B023, E731
                best = max(best, abs(cov(i, j) / math.sqrt(max(cov(i, i), 1e-9) * max(cov(j, j), 1e-9))))
            return best if best >= 0.2 else 0.0

        near = [[correlation(i, j) for j in range(voters)] for i in range(voters)]
        post = []
        for v in votes:
            z = math.log(share / (1 - share)) + sum(ratio[j] / (1 + sum(near[i][j] for i in range(voters) if v[i])) for j in range(voters) if v[j])
            post.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
    return post


# quality rules


def quality_posteriors(rows, rounds):
    """Two classes, independent rules, over single rows of votes (0 abstains, 1 good, 2 bad)."""
    post = [0.02 if 2 in v else 0.98 if 1 in v else 0.7 for v in rows]
    for _ in range(rounds):
        weight = [[1 - p for p in post], list(post)]
        prior = [(sum(w) + 1) / (len(rows) + 2) for w in weight]
        chance = [[[(sum(w for w, v in zip(weight[c], rows) if v[r] == vote) + 0.5) / (sum(weight[c]) + 1.5) for vote in range(3)] for r in range(len(rows[0]))] for c in (0, 1)]
        post = []
        for v in rows:
            z = math.log(prior[1] / prior[0])
            for r, vote in enumerate(v):
                odds = math.log(chance[1][r][vote] / chance[0][r][vote])
                z += max(odds, 0) if vote == 1 else min(odds, 0) if vote == 2 else 0
            post.append(1 / (1 + math.exp(-z)))
    return post
