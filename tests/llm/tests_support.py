"""Brute force that more than one test file uses."""

import re
from collections import Counter, defaultdict


def thue_morse(size: int) -> tuple[str, str]:
    """Two different words of that size that many polynomial hashes take as equal."""
    word = "".join("ab"[i.bit_count() % 2] for i in range(size))
    return word, word.translate(str.maketrans("ab", "ba"))


def brute_near_ids(texts: dict, k: int, percent: int) -> set:
    """The least id of each group of near-copies."""
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets, holders = {}, defaultdict(list)
    for d in sorted(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), texts[d] or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
        common = Counter(o for s in sets[d] for o in holders[s])
        for s in sets[d]:
            holders[s].append(d)
        for o, n in common.items():
            if 100 * n >= percent * (len(sets[d]) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {find(d) for d in texts}
