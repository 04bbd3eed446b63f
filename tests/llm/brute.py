"""Plain Python versions of the operators' definitions, for small inputs."""
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def quality(text):
    w = words(text)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i:i + 8])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    lines = [s for s in (text or "").split("\n") if words(s)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def kept(rows, prior=(2.0, 10_000.0), reject=0.8):
    """Ids of (doc_id, text, source) that base_failed, the host's shrunk rates and the tightened limits leave."""
    facts = {}
    for i, t, s in rows:
        q = quality(t)
        n_lines = sum(bool(words(x)) for x in (t or "").split("\n"))
        facts[i] = (s, q[-1], (q[2], 10, q[1]), (q[3], 30, n_lines))
    over = lambda x, share=1: 100 * x[0] > x[1] * x[2] * share
    fails = {i: (f[1], over(f[2]), over(f[3])) for i, f in facts.items()}
    n = Counter(f[0] for f in facts.values())
    rates = []
    for k in range(3):
        bad = Counter(facts[i][0] for i, x in fails.items() if x[k])
        each = [bad[s] / n[s] for s in n]
        mean, avg = sum(bad.values()) / len(facts), sum(each) / len(each)
        var = sum((r - avg) ** 2 for r in each) / len(each)
        strength = min(max(mean * (1 - mean) / var - 1, prior[0]), prior[1]) if var else prior[1]
        rates.append({s: (bad[s] + mean * strength) / (n[s] + strength) for s in n})
    return {i for i, (s, failed, sym, dup) in facts.items() if not failed and max(r[s] for r in rates) < reject
            and not over(sym, 1 - rates[1][s]) and not over(dup, 1 - rates[2][s])}


def shingles(text):
    w = [x.translate(LOWER) for x in words(text)]
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(rows):
    """{doc_id: smallest reachable id} of (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            n = len(a & b)
            if a and b and 100 * n >= 75 * (len(a) + len(b) - n):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def kneser_ney(train, discounts):
    """p(v, w) of lists of tokens (each without the end)."""
    end, begin = object(), object()
    seqs = [[*t, end] for t in train]
    bi = Counter(p for s in seqs for p in zip([begin, *s], s))
    cont = Counter(w for _, w in bi)
    total, kinds = Counter(), defaultdict(Counter)
    for (v, w), c in bi.items():
        total[v] += c
        kinds[min(c, 3)][v] += 1
    of = lambda counts: [0, *discounts(*[sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)])]
    d1, d2 = of(cont), of(bi)
    spare = sum(d1[min(c, 3)] for c in cont.values()) / len(bi) / (len(cont) + 1)
    uni = lambda w: max(cont[w] - d1[min(cont[w], 3)], 0) / len(bi) + spare

    def p(v, w):
        if not total[v]:
            return uni(w)
        gamma = sum(d2[k] * kinds[k][v] for k in (1, 2, 3)) / total[v]
        return max(bi[v, w] - d2[min(bi[v, w], 3)], 0) / total[v] + gamma * uni(w)

    return p, begin, end, Counter(w for s in seqs for w in s)
