"""Plain re-statements of the operators' definitions, one text at a time."""

import hashlib
import re


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def secrets(text):
    text = text or ""
    spans = {"assign": [], "access": [], "hex": []}
    keyword = "password|passwd|secret|token|api_?key"
    keyword = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in keyword)
    for m in re.finditer(rf"({keyword})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            spans["assign"].append(m.span())
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            spans["access"].append(m.span())
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            spans["hex"].append(m.span())
    rows = sorted((a, i, k, b) for i, (k, v) in enumerate(spans.items()) for a, b in v)
    return *(len(v) for v in spans.values()), sha(said((k, a, b) for a, _, k, b in rows))


def personal(text):
    text = text or ""
    out = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out["phone"].append(m.span())
    rows = [(k, a, b) for k, v in out.items() for a, b in v]
    return *(len(v) for v in out.values()), sha(said(rows))


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        p = phrase.split(" ")
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def contaminated(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    words, hit, ids = cut(text), set(), set()
    for item_id, item in items:
        w = cut(item)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            for j in range(len(words) - size + 1):
                if words[j : j + size] == w[i : i + size]:
                    hit |= set(range(j, j + size))
                    ids.add(str(item_id))
    return len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)


def shingles(text):
    words = (text or "").translate(LOWER).replace("\x1c", "\x1c")
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near(rows, percent=85):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(sets):
        groups.setdefault(find(k), []).append(i)
    out = []
    for k, (i, s) in enumerate(sets):
        least = min((x for x in groups[find(k)] if x is not None), default=None)
        out.append((i, len(s), least, i == least))
    return out
