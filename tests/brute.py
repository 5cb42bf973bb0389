"""Plain versions of the search, position by position."""

from functools import cache


def cost(p, t):
    return 1 if t == "N" else 0 if p == "N" or p == t else 1


def hamming_ends(text, pattern, k):
    m = len(pattern)
    out = {}
    for e in range(m, len(text) + 1):
        d = sum(cost(p, t) for p, t in zip(pattern, text[e - m : e], strict=True))
        if d <= k:
            out[e] = d
    return out


def levenshtein_ends(text, pattern, k):
    col = list(range(len(pattern) + 1))
    out = {}
    for e, t in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(col[i - 1] + cost(p, t), col[i] + 1, new[-1] + 1))
        col = new
        if col[-1] <= k:
            out[e] = col[-1]
    return out


def alignment(pattern, text, plus):
    """(operations, target length, ambiguous cells) by the definition: M before D before I from the end, by recursion.

    A plus hit ends with the text and may begin anywhere in it; a minus hit begins with the text and ends where the
    distance is first least. A minus hit's text before the pattern's first base is left out.
    """

    def cost(p, t):  # in alignments a pattern's N matches a masked base too
        return int(p != "N" and (t == "N" or p != t))

    @cache
    def least(i, j):
        if i == 0:
            return 0 if plus else j
        ways = [least(i - 1, j) + 1]
        if j:
            ways += [least(i - 1, j - 1) + cost(pattern[i - 1], text[j - 1]), least(i, j - 1) + 1]
        return min(ways)

    def walk(i, j):
        if i == 0 or j == 0:
            return "I" * i, 0
        ways = [(op, u, v) for op, u, v, c in (("M", i - 1, j - 1, cost(pattern[i - 1], text[j - 1])), ("D", i, j - 1, 1), ("I", i - 1, j, 1)) if least(i, j) == least(u, v) + c]
        ops, ambiguous = walk(*ways[0][1:])
        return ops + ways[0][0], ambiguous + (len(ways) > 1)

    m = len(pattern)
    end = len(text)
    if not plus:
        low = min((least(m, j) for j in range(1, end + 1)), default=m)
        end = end if least(m, end) == low else next(j for j in range(1, end) if least(m, j) == low)
    ops, ambiguous = walk(m, end)
    return ops, sum(op != "I" for op in ops), ambiguous, end


def distance(pattern, text):
    """Global edit distance, masked bases of the text costing 1."""
    row = list(range(len(text) + 1))
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + cost(p, t), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def complement(s):
    return s.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]


def motif_ends(seq, guide, k, fits, size, side, plus):
    """Ends at which a target of some length is within k of the guide and has the motif beside it."""
    out = set()
    for e in range(1, len(seq) + 1):
        for n in range(max(1, len(guide) - k), min(e, len(guide) + k) + 1):
            target = seq[e - n : e]
            after = plus == (side == "3")
            bases = seq[e : e + size] if after else seq[max(0, e - n - size) : e - n]
            if fits(bases if plus else complement(bases)) and distance(guide, target if plus else complement(target)) <= k:
                out.add(e)
    return out
