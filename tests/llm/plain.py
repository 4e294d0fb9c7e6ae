"""Plain Python versions of the document operators, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def repeats(texts, n):
    """Length, removed bytes, removed runs and digest of what is kept, for each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, k in Counter(windows).items() if k > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(inside), failed


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, bits=3):
    """Index of the group of each fingerprint; groups are linked at ``bits`` or fewer differing bits."""
    different = sorted(set(prints))
    root = {p: p for p in different}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, a in enumerate(different):
        for b in different[i + 1 :]:
            if (a ^ b).bit_count() <= bits:
                root[find(b)] = find(a)
    return [find(p) for p in prints]


def spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                odd = sum(map(int, digits[::-1][::2]))
                even = sum(sum(divmod(2 * int(d), 10)) for d in digits[::-1][1::2])
                if not 13 <= len(digits) <= 19 or (odd + even) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def mask(text):
    out, at = "", 0
    for kind, start, stop in sorted(spans(text), key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, stop)
    return out + text[at:]


def listed(found):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", (text or "").lower()))


def mix(rows):
    """``copies`` and the target of each row (id, text, source), ids distinct."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    by_source = defaultdict(list)
    for i, _, s in rows:
        by_source[s].append(i)
    order = sorted((s for s in by_source if s is not None)) + [None] * (None in by_source)
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total_of = {s: sum(size[i] for i in by_source[s]) for s in order}
    total, above = sum(total_of.values()), set()
    while True:
        left = total - sum(3 * total_of[s] for s in above)
        weights = sum(weight[s] for s in order if s not in above)
        target = {s: 3.0 * total_of[s] if s in above else weight[s] * (left / weights) for s in order}
        over = {s for s in order if s not in above and target[s] > 3 * total_of[s]}
        if not over:
            break
        above |= over
    queue = []
    for place, s in enumerate(order):
        sent = 0
        for copy in range(3):
            for i in sorted(by_source[s], key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
                sent += size[i]
                if 2 * sent - size[i] < 2 * target[s]:
                    queue.append((sent / target[s], place, hashlib.md5(str(i).encode()).hexdigest(), i, copy))
    copies, used = Counter(), 0
    for _, _, _, i, _ in sorted(queue):
        used += size[i]
        if used > total:
            break
        copies[i] += 1
    return {i: (copies[i], target[s]) for i, _, s in rows}


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([tuple(words)])


def first_similar(rows):
    """Ids that stay when components of all pairs of five-word similarity 0.8 are reduced to their least id."""
    rows = sorted(rows)
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return {rows[r][0] for r in root}


EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’…–—¿¡"


def template(text, units):
    """Words of a text: what stands for each in a template, the word in lower case, and whether a sentence begins there."""
    out, begins, number = [], True, False
    for line in (text or "").split("\n"):
        for raw in WORD.findall(line):
            word = raw.strip(EDGES)
            low = word.lower()
            if not low:
                begins = begins or raw[-1] in ".!?"
                continue
            kind = low
            if any(c in "0123456789" for c in low):
                kind = "<number>"
            elif low in units and number:
                kind = "<unit>"
            elif len(word) > 1 and word[0].isupper() and word[1:] == word[1:].lower() and not begins:
                kind = "<name>"
            out.append((kind, low, begins))
            number = kind == "<number>"
            begins = raw[-1] in ".!?:;" or (raw[-1] in "\"')]" and raw[-2:-1] != "" and raw[-2:-1] in ".!?")
        begins = True
    return out


def leaks(doc, item, units, window=8, literals=5, phrase=4):
    """Whether a document holds an item, by windows of template words with consistent slots."""
    d, i = template(doc, units), template(item, units)
    width = min(window, len(i))
    if not width or len(d) < width or (width < phrase and len(d) > width):
        return False
    slots = lambda words: tuple(low for kind, low, _ in words if kind.startswith("<"))
    # by what the words of a window are in a template, and by the words in lower case: where the document has it
    templates, exact = defaultdict(list), defaultdict(list)
    for q in range(len(d) - width + 1):
        own = d[q : q + width]
        if width == window or (own[0][2] and (q + width == len(d) or d[q + width][2])):
            templates[tuple(k for k, _, _ in own)].append(q)
            exact[tuple(w for _, w, _ in own)].append(q)
    met = defaultdict(set)  # by shift: place in the item, whether judged, pairs of slot values
    places = range(len(i) - width + 1)
    judged = {p for p in places if sum(not k.startswith("<") for k, _, _ in i[p : p + width]) >= min(literals, width)}
    for p in places:
        mine = i[p : p + width]
        if p in judged:
            for q in templates.get(tuple(k for k, _, _ in mine), ()):
                met[q - p].add((p, True, tuple(zip(slots(mine), slots(d[q : q + width])))))
        for q in exact.get(tuple(w for _, w, _ in mine), ()):
            if slots(mine) or slots(d[q : q + width]):
                met[q - p].add((p, p in judged, ()))
    for found in met.values():
        pairs = {pair for _, _, own in found for pair in own}
        clash = {a for a in pairs for b in pairs if (a[0] == b[0]) != (a[1] == b[1])}
        kept = [(p, j) for p, j, own in found if not clash & set(own)]
        matched, sure = len({p for p, _ in kept}), len({p for p, j in kept if j})
        if sure and sure >= min(0.3 * len(judged), 6):
            return True
        if matched and matched >= min(0.3 * len(places), 6):
            return True
    return False
