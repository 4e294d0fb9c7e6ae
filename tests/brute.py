"""Brute-force answers in NumPy for small fixtures."""

import numpy as np


def distances(x, metric):
    x = np.asarray(x, float)
    if metric == "cosine":
        length = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        d = np.clip(1 - unit @ unit.T, 0, 2)
    else:
        d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(-1))
    np.fill_diagonal(d, 0)
    return d


def dbscan(x, eps, min_samples, metric, weight=None):
    close = distances(x, metric) <= eps
    weight = np.ones(len(close)) if weight is None else np.asarray(weight)
    core = close @ weight >= min_samples
    label = np.full(len(close), -1)
    found = 0
    for seed in np.flatnonzero(core):
        if label[seed] != -1:
            continue
        todo = [seed]
        while todo:
            p = todo.pop()
            if label[p] == -1:
                label[p] = found
                if core[p]:
                    todo += np.flatnonzero(close[p] & (label == -1)).tolist()
        found += 1
    return label, core


def silhouette(x, label):
    keep = np.asarray(label) != -1
    x, label = np.asarray(x)[keep], np.asarray(label)[keep]
    names = np.unique(label)
    if not 2 <= len(names) < len(label):
        return None
    d = distances(x, "l2")
    scores = []
    for i in range(len(x)):
        own = label == label[i]
        if own.sum() == 1:
            scores.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == n].mean() for n in names if n != label[i])
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(scores))


def davies_bouldin(x, label):
    keep = np.asarray(label) != -1
    x, label = np.asarray(x, float)[keep], np.asarray(label)[keep]
    names = np.unique(label)
    if not 2 <= len(names) < len(label):
        return None
    c = np.array([x[label == n].mean(0) for n in names])
    s = np.array([np.linalg.norm(x[label == n] - c[i], axis=1).mean() for i, n in enumerate(names)])
    worst = []
    for i in range(len(c)):
        gap = np.linalg.norm(c - c[i], axis=1)
        worst.append(max((s[i] + s[j]) / gap[j] if gap[j] > 0 else 0.0 for j in range(len(c)) if j != i))
    return float(np.mean(worst))


def calinski_harabasz(x, label):
    keep = np.asarray(label) != -1
    x, label = np.asarray(x, float)[keep], np.asarray(label)[keep]
    names = np.unique(label)
    middle = x.mean(0)
    between = sum((label == n).sum() * ((x[label == n].mean(0) - middle) ** 2).sum() for n in names)
    within = sum(((x[label == n] - x[label == n].mean(0)) ** 2).sum() for n in names)
    if within == 0:
        return 1.0
    return float(between * (len(x) - len(names)) / (within * (len(names) - 1)))
