"""The contracts of the operators, row by row in plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SMALL = "/root/testdata/sf0.001"
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
NOT_BLANK = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs: list[tuple], items: list[tuple], n: int = 10) -> list[tuple]:
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(names), sha(",".join(names)), bool(hit)))
    return out


def repeats(docs: list[tuple], n: int = 35) -> list[tuple]:
    split = [(doc, NOT_BLANK.findall(text or "")) for doc, text in docs]
    count = Counter(tuple(w[k : k + n]) for _, w in split for k in range(len(w) - n + 1))
    out = []
    for doc, w in split:
        gone = {j for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for j in range(k, k + n)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def near(docs: list[tuple], n: int = 5, percent: int = 80) -> list[tuple]:
    sets = []
    for _, text in docs:
        w = NOT_BLANK.findall(lower(text))
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1) if w else 0)))
    parent = list(range(len(docs)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    smallest: dict[int, int | None] = {}
    for i, (doc, _) in enumerate(docs):
        known = smallest.get(root(i))
        smallest[root(i)] = doc if known is None else known if doc is None else min(known, doc)
    return [(doc, len(sets[i]), smallest[root(i)]) for i, (doc, _) in enumerate(docs)]


SECRETS = (
    (
        "assign",
        re.compile(
            "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"
            "[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
        ),
        2,
        12,
    ),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
)


def secrets(docs: list[tuple]) -> list[tuple]:
    out = []
    for doc, text in docs:
        found = []
        for order, (_, pattern, group, least) in enumerate(SECRETS):
            found += [(m.start(), order, m.end()) for m in pattern.finditer(text or "") if len(m[group]) >= least]
        found.sort()
        named = ",".join(f"{SECRETS[k][0]}:{s}:{e}" for s, k, e in found)
        out.append((doc, *(sum(k == j for _, k, _ in found) for j in range(3)), sha(named)))
    return out

def near_words(docs, items, within, n=10):
    """(doc_id, words in minimal runs that hold a window's words, items with one), by trying every run."""
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall(lower(text))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(sorted(w[k : k + n]))].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for window, names in windows.items():
            need = Counter(window)
            for i in range(len(w)):
                for j in range(i + 1, min(len(w), i + within) + 1):
                    here = Counter(w[i:j])
                    if not need - here:
                        # Minimal: neither end can go.
                        if need - Counter(w[i + 1 : j]) and need - Counter(w[i : j - 1]):
                            hit.update(range(i, j))
                            found |= names
                        break
        out.append((doc, len(hit), len({x for x in found if x is not None})))
    return out


def toxicity(rows, labels, judges, held, settings, reach, background, min_count, expected, curve):
    """{row number: (n_words, passages, evidence, score)} by the definitions, with dictionaries of strings.

    `rows` are (id, text), `labels` {id: 0 or 1}, `judges` and `held` sets of ids; `curve` fits a logistic curve.
    """
    import math
    import re
    from collections import Counter

    texts = [re.findall(rb"[0-9a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())) for _, t in rows]

    def names(word):
        return [(4, word[:4]), (5, word[:5]), (6, word[:6]), (0, word)]

    own = [{f for word in t for f in names(word)} for t in texts]
    kind = [labels.get(i) if i not in held else None for i, _ in rows]
    every = Counter(f for x in own for f in x)
    total = sum(map(bool, texts))

    def weights(members, setting):
        toxic = [x for k, x in enumerate(own) if k in members and kind[k] == 1 and x]
        harmless = [x for k, x in enumerate(own) if k in members and kind[k] == 0 and x]
        n1, n0 = len(toxic), len(harmless)
        a, b = Counter(f for x in toxic for f in x), Counter(f for x in harmless for f in x)
        strength, out = 0.1 * (n0 + n1), {}
        for f, n in a.items():
            if n < min_count:
                continue
            prior = strength * every[f] / total
            rest1, rest0, rest = (max(v, 1e-9) for v in (n1 + strength - n - prior, n0 + strength - b[f] - prior, n0 + strength - prior))
            odds = math.log((n + prior) / rest1) - math.log((b[f] + prior) / rest0)
            z = odds / math.sqrt(1 / (n + prior) + 1 / (b[f] + prior))
            most = math.log((n + prior) / rest1) - math.log(prior / rest)
            out[f] = odds if z >= setting[0] and odds >= min(setting[1], reach * most) else background
        return out

    def segments(s):
        """By definition: the best stretch, then those on either side of it."""
        def split(a, b):
            best, span, low, at = 0.0, None, 0.0, a
            running = 0.0
            for i in range(a, b):
                running += s[i]
                if running - low > best + 1e-12:
                    best, span = running - low, (at, i + 1)
                if running <= low:
                    low, at = running, i + 1
            if span is None:
                return []
            return split(a, span[0]) + [(*span, sum(s[span[0] : span[1]]))] + split(span[1], b)

        return split(0, len(s)) if any(x > 0 for x in s) else []

    def model(members, setting):
        w = weights(members, setting)
        scores = [[next((w[f] for f in reversed(names(word)) if f in w), background) for word in t] for t in texts]
        found = [segments(s) for s in scores]
        null = [k for k in sorted(members) if kind[k] == 0]
        n_words = sum(len(texts[k]) for k in null)
        positive = [v for v in w.values() if v > 0]
        levels = [v for k in null for v in scores[k] if v > 0] + [sum(positive) / len(positive) if positive else 1.0]
        low, high = 1e-6, 50.0
        for _ in range(100):
            middle = (low + high) / 2
            mean = sum(math.exp(min(middle * v, 700)) for v in levels) + (n_words + 1 - len(levels)) * math.exp(middle * background)
            low, high = (low, middle) if mean > n_words + 1 else (middle, high)
        best = [max((x for _, _, x in found[k]), default=0.0) for k in null]
        scale = 1 / max(sum(len(texts[k]) * math.exp(-low * v) for k, v in zip(null, best)) / len(null), 1.0)
        out = []
        for t, f in zip(texts, found):
            surprise = [x * low - math.log(max(len(t), 1) * scale) for _, _, x in f]
            chosen = [k for k, v in enumerate(surprise) if v >= -math.log(expected)]
            evidence = sum(surprise[k] for k in chosen) if chosen else min(max(surprise, default=0.0), 0.0)
            out.append((len(t), [f[k][:2] for k in chosen], evidence))
        learn = [k for k in sorted(members) if kind[k] is not None]
        capped = [max(-30.0, min(30.0, e)) for _, _, e in out]
        slope, middle = curve([round(capped[k], 3) for k in learn], [kind[k] for k in learn])
        return [(*x, 1 / (1 + math.exp(-(v * slope + middle)))) for x, v in zip(out, capped)]

    learnable = {k for k in range(len(rows)) if kind[k] is not None}
    judged = {k for k in learnable if rows[k][0] in judges}
    errors = []
    for setting in settings:
        got = model(learnable - judged, setting)
        wrong = [[(got[k][3] >= 0.5) != (y == 1) for k in judged if kind[k] == y] for y in (0, 1)]
        loss = [[-math.log(max(got[k][3] if y else 1 - got[k][3], 1e-12)) for k in judged if kind[k] == y] for y in (0, 1)]
        errors.append([sum(sum(x) / len(x) / 2 for x in each) for each in (wrong, loss)])
    best = min(range(len(settings)), key=lambda k: errors[k])
    return settings[best], dict(enumerate(model(learnable, settings[best])))
