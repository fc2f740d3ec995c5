"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text, lower=True):
    return WORD.findall((text or "").translate(LOWER) if lower else text or "")


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(docs):
    """doc_id -> smallest id reachable over links of similarity 0.75 and more."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def contaminated(docs, items):
    """(doc_id, item_id, shared) of contained items."""
    out = set()
    wanted = [(i, words(t), shingles(t)) for i, t in items]
    for d, text in docs:
        own, every = shingles(text), words(text)
        for i, w, s in wanted:
            if 0 < len(w) < 5:
                if any(every[k : k + len(w)] == w for k in range(len(every))):
                    out.add((d, i, 1))
            elif s and 4 * len(s & own) >= 3 * len(s):
                out.add((d, i, len(s & own)))
    return out


ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)


def spans(text, kinds, scope=400):
    """All spans: the base ones and the weak ones with complementary parts near."""
    text = text or ""
    every = base_spans(text)
    for k, kind in enumerate(kinds):
        if kind.weak:
            for m in re.finditer(kind.pattern, text):
                if all(re.search(n, m[0]) for n in kind.needs):
                    every.append((m.start(), k, m.end()))
    out = []
    for s, k, e in every:
        near = {kinds[q].part for a, q, _ in every if abs(a - s) <= scope}
        need = {"identifier": {"secret"}, "secret": {"identifier"}, "endpoint": {"secret", "identifier"}}[kinds[k].part]
        if not kinds[k].weak or need <= near:
            out.append((s, k, e))
    return sorted(out)


def masked(text, found, mask="[secret]"):
    out, at = [], 0
    for s, _, e in found:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """source -> target, by sharing again and again what exceeds a cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        left = budget - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in order if s not in full)
        over = {s for s in order if s not in full and w[s] * left / total > most * sizes[s]} if total else set()
        if not over:
            return {s: most * sizes[s] if s in full else w[s] * left / total for s in order}
        full |= over


def mix(docs, seed="mix"):
    """(doc_id, source, size) -> (source_size, target, copies); docs are (doc_id, source, text)."""
    rows = [(d, s, len(words(t))) for d, s, t in docs]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    goal, out = targets(sizes) if sizes else {}, []
    for source in sizes:
        shift = (int(hashlib.md5(f"{seed}|{source or ''}".encode()).hexdigest()[:5], 16) + 0.5) / (1 << 20)
        rate = goal[source] / sizes[source] if sizes[source] else 0.0
        own = sorted((n, d) for d, s, n in rows if s == source)
        for k, (n, d) in enumerate(own):
            out.append((d, source, n, sizes[source], goal[source], math.floor((k + 1) * rate + shift) - math.floor(k * rate + shift)))
    return out


def passage_features(text, size=512):
    """Features of every passage of a text, byte by byte and word by word."""
    from mergewell.llm.quality import CLASS_OF, CLASSES

    body = (text or "").encode()
    kinds = [int(CLASS_OF[b]) for b in body]
    after = kinds[1:] + [1]
    found = [(m.start(), m[0].translate(LOWER_BYTES)) for m in re.finditer(rb"[^\x20\x09-\x0d]+", body)]
    out = []
    for k in range(max(1, -(-len(body) // size))):
        spots = range(k * size, min(len(body), (k + 1) * size))
        row = [0.0] * (CLASSES * CLASSES + 4)
        for i in spots:
            row[kinds[i] * CLASSES + after[i]] += 1
        length = max(1, len(spots))
        row = [math.sqrt(x / length) for x in row]
        row[-4] = length / size if body else 1 / size
        own = [n for n, (start, _) in enumerate(found) if start // size == k]
        n = max(1, len(own))
        row[-3] = min(sum(len(found[i][1]) for i in own) / n / 16, 8)
        for back in (1, 2):
            row[-3 + back] = sum(i >= back and found[i][1] == found[i - back][1] for i in own) / n
        out.append(row)
    return out


LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def quality_score(text, p, mean, scale):
    """Gated attention over the passages of one text, number by number."""
    total = lambda v, m, k: sum(a * b for a, b in zip(v, (row[k] for row in m)))
    logistic = lambda x: 1 / (1 + math.exp(-x))
    encoded, energies = [], []
    for row in passage_features(text):
        x = [(a - b) / c for a, b, c in zip(row, mean, scale)]
        h = [math.tanh(total(x, p["W"], k) + p["b"][k]) for k in range(len(p["b"]))]
        gates = [math.tanh(total(h, p["V"], k)) * logistic(total(h, p["U"], k)) for k in range(len(h))]
        encoded.append(h)
        energies.append(sum(a * b for a, b in zip(gates, p["w"])))
    weights = [math.exp(e - max(energies)) for e in energies]
    z = [sum(w * h[k] for w, h in zip(weights, encoded)) / sum(weights) for k in range(len(p["c"]))]
    return logistic(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0])


def language_words(text):
    """The trigrams of each word of letters, as buckets."""
    import numpy as np

    from mergewell.llm.textkernel import mix as scramble

    body = (text or "").encode().translate(LOWER_BYTES)
    letter = lambda b: 97 <= b <= 122 or b >= 128
    clean = [32, *[b if letter(b) else 32 for b in body], 32]
    out, word = [], []
    for i in range(1, len(clean)):
        if clean[i] == 32:
            if word:
                out.append(word)
            word = []
        else:
            code = np.array([clean[i - 1] << 16 | clean[i] << 8 | clean[i + 1]], np.uint64)
            word.append(int(scramble(code)[0]) >> 49)
    return out


def languages(train, texts, rounds=8, penalty=1.0, buckets=1 << 15):
    """language -> proportion of every text, from ``train`` (lang, text)."""
    counts = {}
    for lang, text in train:
        for word in language_words(text):
            for b in word:
                own = counts.setdefault(lang, {})
                own[b] = own.get(b, 0) + 1
    langs = sorted(counts)
    log_p = lambda lang, b: math.log((counts[lang].get(b, 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * buckets))

    def fit(likely, share, n):
        for _ in range(n):
            sums = dict.fromkeys(share, 0.0)
            for row in likely:
                total = sum(row[x] * share[x] for x in share)
                for x in share:
                    sums[x] += row[x] * share[x] / total
            share = {x: v / len(likely) for x, v in sums.items()}
        return share, sum(math.log(sum(row[x] * share[x] for x in share)) for row in likely)

    out = []
    for text in texts:
        likely = []
        for word in language_words(text):
            row = {x: sum(log_p(x, b) for b in word) for x in langs}
            top = max(row.values())
            likely.append({x: math.exp(v - top) + 1e-12 for x, v in row.items()})
        if not likely or not langs:
            out.append({})
            continue
        share, _ = fit(likely, dict.fromkeys(langs, 1 / len(langs)), rounds)
        order = sorted(langs, key=lambda x: (-share[x], x))
        best, kept = -math.inf, {}
        for size in range(1, len(langs) + 1):
            fitted, reached = fit(likely, dict.fromkeys(order[:size], 1 / size), rounds if size > 1 else 0)
            reached -= penalty * size * math.log(max(len(likely), 2))
            if reached <= best:
                break
            best, kept = reached, fitted
        out.append(kept)
    return out
