"""Plain versions of the text operators, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = r"[^\x20\x09-\x0D]+"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def words(text):
    return re.findall(WORD, text or "")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(texts, length=200):
    """(n_bytes, n_removed, n_spans, kept digest) of every text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, sha(bytes(b for b, g in zip(d, gone) if not g))))
    return out


def shingles(text, k=4, low=True):
    w = words(lowered(text) if low else text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def near_classes(rows, percent=85):
    """rows (id, text) to {id: (set size, least id linked)}; ids are distinct."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def line_tokens(line):
    return tuple("<*>" if re.search(r"\d", w) else w for w in line.split())


def line_dedup(rows, min_docs, depth=4, wild=1, least=4, share=80):
    """rows (id, text) to {id: (n_lines, n_dropped, kept text)}; equal texts count as one document."""
    n_docs, where = Counter(), defaultdict(set)
    first = {}
    for i, text in rows:
        first[text] = min(i, first.get(text, i))
    for text, i in first.items():
        for k in {line_tokens(x) for x in (text or "").split("\n")}:
            if k:
                n_docs[k] += 1
                where[k].add(i)
    at_lead = Counter()
    for k, n in n_docs.items():
        for place, w in enumerate(k[:depth]):
            at_lead[len(k), place, w] += n
    leaves = defaultdict(dict)
    for k, n in n_docs.items():
        rare = [w != "<*>" and at_lead[len(k), place, w] < min_docs for place, w in enumerate(k[:depth])]
        plain = sum(w != "<*>" for w in k)
        stays = plain - sum(rare)
        if not any(rare) or (sum(rare) <= wild and stays >= least and 100 * stays >= share * plain):
            leaves[len(k), tuple("<*>" if r else w for r, w in zip(rare, k))][k] = n
    docs, members = defaultdict(set), defaultdict(list)
    for lines in leaves.values():
        at = Counter()
        for k, n in lines.items():
            for place, w in enumerate(k):
                at[place, w] += n
        for k, n in lines.items():
            shape = tuple(w if w != "<*>" and at[place, w] >= min_docs else "<*>" for place, w in enumerate(k))
            fixed = [w for w in shape if w != "<*>"]
            plain = [w for w in k if w != "<*>"]
            varied = len(fixed) >= least and 100 * len(fixed) >= share * len(plain)
            lettered = any(c.isalpha() for w in fixed for c in w) or len(plain) == len(k)
            if lettered and (varied or n >= min_docs):
                docs[shape] |= where[k]
                members[shape].append(k)
    gone = {k for shape, ids in docs.items() if len(ids) >= min_docs for k in members[shape]}
    out = {}
    for i, text in rows:
        lines = [] if text is None else text.split("\n")
        kept = [x for x in lines if line_tokens(x) not in gone]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def quality_base(text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def katz(rows, discounts):
    """rows (id, text), discounts(count of counts) to {id: (held_out, n_tokens, n_known, N, base, score)} and the model's probability."""
    tokens = {i: [*words(lowered(t)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two, context, after = Counter(), Counter(), Counter(), defaultdict(set)
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            for a, b in zip(["<s>", *w], w):
                two[a, b] += 1
                context[a] += 1
                after[a].add(b)
    total, distinct = sum(one.values()), len(one)
    n1, n2 = Counter(one.values()), Counter(two.values())
    d1, d2 = (discounts([n[r] for r in range(1, 7)]) for n in (n1, n2))
    unknown = 1 - sum(d1[min(c, 6)] * c / total for c in one.values())

    def alone(w):
        return d1[min(one[w], 6)] * one[w] / total if one[w] else unknown

    def probability(w, v):
        if not context[v]:
            return alone(w)
        if two[v, w]:
            return d2[min(two[v, w], 6)] * two[v, w] / context[v]
        left = 1 - sum(d2[min(two[v, x], 6)] * two[v, x] / context[v] for x in after[v])
        return left / (1 - sum(alone(x) for x in after[v])) * alone(w)

    out = {}
    for i, w in tokens.items():
        score = sum(math.log10(probability(b, a)) for a, b in zip(["<s>", *w], w))
        base = sum(math.log10((one[x] + 1) / (total + distinct + 1)) for x in w)
        out[i] = (held[i], len(w), sum(one[x] > 0 for x in w), total, base, score)
    return out, probability, one, unknown
