"""Line dedup over all pairs of documents that share a line, with an alignment of its own."""

from collections import Counter


def table(a, b):
    """Lengths of longest common subsequences of all prefixes."""
    out = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(out[-1][j] + 1 if x == y else max(out[-1][j + 1], row[-1]))
        out.append(row)
    return out


def subsequence(a, b):
    """From the end: the shortest prefix of b that is as good, then a's last item if it is needed."""
    t, i, j, out = table(a, b), len(a), len(b), set()
    while i and t[i][j]:
        while t[i][j] == t[i][j - 1]:
            j -= 1
        if t[i - 1][j] < t[i][j]:
            out.add((i - 1, j - 1))
            j -= 1
        i -= 1
    return out


def align(a, b):
    """Common ends; else the longest run of items that are once in both, its parts alike; else a common subsequence."""
    if not a or not b:
        return set()
    if a[0] == b[0]:
        return {(0, 0)} | {(i + 1, j + 1) for i, j in align(a[1:], b[1:])}
    if a[-1] == b[-1]:
        return {(len(a) - 1, len(b) - 1)} | align(a[:-1], b[:-1])
    in_a, in_b = Counter(a), Counter(b)
    once = [(i, b.index(x)) for i, x in enumerate(a) if in_a[x] == 1 == in_b[x]]
    if not once:
        return subsequence(a, b)
    # The longest ascending run; of equal ones the one that a patience sort leaves: its ends are the smallest.
    best = []
    for n, (i, j) in enumerate(once):
        length, before = max(((best[m][0], m) for m in range(n) if once[m][1] < j), default=(0, -1), key=lambda x: (x[0], x[1]))
        best.append((length + 1, before))
    n = max(range(len(once)), key=lambda n: (best[n][0], n))
    run = []
    while n >= 0:
        run.append(once[n])
        n = best[n][1]
    out, i0, j0 = set(), 0, 0
    for i, j in [*run[::-1], (len(a), len(b))]:
        out |= {(i0 + p, j0 + q) for p, q in align(a[i0:i], b[j0:j])}
        if (i, j) != (len(a), len(b)):
            out.add((i, j))
        i0, j0 = i + 1, j + 1
    return out


def plain_lines(texts):
    """The text that is left of each of texts (in order), every two of them aligned."""
    lines = [[x.strip(" \t\n\v\f\r") for x in t.split("\n")] for t in texts]
    holders = Counter(x for own in lines for x in set(own) if x)
    shared = [[(i, x) for i, x in enumerate(own) if x and holders[x] > 1] for own in lines]
    out = []
    for d, own in enumerate(shared):
        gone = set()
        for e in range(d):
            if {x for _, x in own} & {x for _, x in shared[e]}:
                gone |= {own[j][0] for _, j in align([x for _, x in shared[e]], [x for _, x in own])}
        solid = [i for i, x in enumerate(lines[d]) if x]
        for i, x in enumerate(lines[d]):
            if not x and gone:
                left, right = [k for k in solid if k < i], [k for k in solid if k > i]
                if (not left or left[-1] in gone) and (not right or right[0] in gone):
                    gone.add(i)
        kept = [x for i, x in enumerate(texts[d].split("\n")) if i not in gone]
        out.append(texts[d] if not gone else "\n".join(kept) if any(x.strip(" \t\n\v\f\r") for x in kept) else "")
    return out
